import datetime

import pytest
from pyspark.sql import functions as F

from answerloom.operators import boards, voting
from answerloom.streaming import jobs, states

VOTE = "arena string, seq long, winner string, loser string"


def arrive(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_online_elo_equals_the_fold(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, f"m{i % 4}", f"m{(i * 5 + 1) % 7}") for i in range(60)]
    votes = spark.createDataFrame(rows, VOTE)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low in (0, 20, 40):
        arrive(votes.where(F.col("seq").between(low, low + 19)), src)
    late = spark.createDataFrame([("a", 5, "m0", "m1")], VOTE)
    arrive(late, src)
    stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.drain(jobs.write_batches(states.online_elo(stream), out, state, output_mode="update"))
    updates = spark.read.parquet(out)
    got = {(r.arena, r.model): r.rating for r in jobs.latest(updates, ["arena", "model"]).collect()}
    want = {(r.arena, r.model): r.rating for r in boards.elo(votes).collect()}
    assert got == pytest.approx(want)


def test_online_majority_equals_the_batch(spark, tmp_path):
    rows = [(i, s, "xyz"[(i * s + s // 2) % 3], 5) for i in range(12) for s in range(5)]
    schema = "item long, sample_idx long, answer string, num_samples long"
    samples = spark.createDataFrame(rows, schema)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low, high in ((0, 1), (2, 3), (4, 4)):
        arrive(samples.where(F.col("sample_idx").between(low, high)), src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.drain(jobs.write_batches(states.online_majority(stream), out, state))
    got = {(r.item, r.n_used): r.final_answer for r in spark.read.parquet(out).collect()}
    batch = voting.early_stopped_vote(samples).collect()
    want = {(r.item, r.n_samples): r.final_answer if r.top_count * 2 > 5 else None for r in batch}
    assert got == want


def test_chunk_stream_runs_again_without_doubling(spark, tmp_path):
    files = spark.createDataFrame([("a", "x" * 25), ("b", "y" * 5)], "file string, text string")
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrive(files, src)

    def run():
        stream = spark.readStream.schema("file string, text string").parquet(src)
        jobs.drain(jobs.chunk_stream(stream, out, state, size=10, overlap=0))
        return sorted((r.file, r.pos, r.chunk) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == [("a", 0, "x" * 10), ("a", 1, "x" * 10), ("a", 2, "x" * 5), ("b", 0, "y" * 5)]
    assert run() == first
    arrive(files, src)
    assert run() == first
    arrive(spark.createDataFrame([("b", "z")], "file string, text string"), src)
    assert run() == sorted([*first, ("b", 0, "z")])


def test_chunk_stream_reads_no_earlier_output(spark, tmp_path):
    files = spark.createDataFrame([("a", "x" * 25), ("b", "y" * 5), (None, "n")], "file string, text string")
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    outs = [str(tmp_path / f"out{i}") for i in range(2)]
    arrive(files, src)

    def run(out):
        stream = spark.readStream.schema("file string, text string").parquet(src)
        jobs.drain(jobs.chunk_stream(stream, out, state, size=10, overlap=0))
        return sorted(r.chunk for r in spark.read.parquet(out).collect())

    assert run(outs[0]) == ["n", "x" * 5, "x" * 10, "x" * 10, "y" * 5]
    arrive(files.unionAll(files), src)
    arrive(spark.createDataFrame([("b", "z")], "file string, text string"), src)
    # The second table is new and empty: only the state knows what came before.
    assert run(outs[1]) == ["z"]
    # A batch whose end was not recorded runs again from the same state into the same place.
    commits = sorted(int(f.name) for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    assert run(outs[1]) == ["z"]


def test_chunk_stream_forgets_after_a_while(spark, tmp_path):
    schema = "file string, text string, at timestamp"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    waves = [("a", "x", 1), ("a", "x", 2), ("b", "y", 20), ("c", "w", 21), ("a", "x", 22)]
    found = []
    for file, text, day in waves:
        at = datetime.datetime(2024, 1, day)
        arrive(spark.createDataFrame([(file, text, at)], schema), src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.drain(jobs.chunk_stream(stream, out, state, arrived="at", remember="5 days"))
        found.append(sorted(r.chunk for r in spark.read.parquet(out).collect()))
    assert found == [["x"], ["x"], ["x", "y"], ["w", "x", "y"], ["w", "x", "x", "y"]]
    with pytest.raises(ValueError):
        jobs.chunk_stream(spark.readStream.schema(schema).parquet(src), out, state, remember="5 days")


def test_majority_state_goes_with_the_last_sample(spark, tmp_path):
    import time

    schema = "item long, sample_idx long, answer string, num_samples long"
    rows = [(1, s, "x", 3) for s in range(3)] + [(2, s, "xy"[s], 3) for s in range(2)]
    samples = spark.createDataFrame(rows, schema)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    states.use_keyed_state(spark)
    for low in range(3):
        arrive(samples.where(F.col("sample_idx") == low), src)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    # Timers need a query that goes on: an available-now one would wait for them for ever.
    query = jobs.write_batches(
        states.online_majority(stream, idle_ms=500), out, state, trigger={"processingTime": "300 milliseconds"}
    )
    try:
        deadline, got = time.time() + 60, []
        while time.time() < deadline and len(got) < 2:
            time.sleep(1)
            try:
                got = sorted((r.item, r.final_answer) for r in spark.read.schema("item long, final_answer string").parquet(out).collect())
            except Exception:  # noqa: BLE001  nothing written yet, or a file just replaced
                got = []
        kept = [op.get("numRowsTotal") for p in query.recentProgress for op in p["stateOperators"]]
    finally:
        query.stop()
    # The second item never gets its third sample: its timer gives it back undecided.
    assert got == [(1, "x"), (2, None)]
    assert max(kept) > 0 and kept[-1] == 0
