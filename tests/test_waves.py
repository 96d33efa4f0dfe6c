"""Streams with many small keys, and tables whose files are in no order."""

import os

import duckdb
import pytest

from answerloom.catalog import live, load
from answerloom.operators import voting
from answerloom.streaming import jobs, states
from oracle import ROOT, compare

SAMPLES = "item long, sample_idx long, answer string, num_samples long"


def test_majority_takes_many_items_a_key(spark, tmp_path):
    rows = [(i, s, "xyz"[(i * s + s // 2) % 3], 5) for i in range(-40, 400) for s in range(5)]
    rows += [(None, 0, "x", 3), (None, 1, "x", 3), (None, 2, "y", 3)]
    rows += [(900, 0, None, 3), (900, 1, None, 3), (900, 2, "y", 3), (901, 0, "z", 9)]
    samples = spark.createDataFrame(rows, SAMPLES)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low, high in ((0, 1), (2, 2), (3, 4)):
        samples.where(samples.sample_idx.between(low, high)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SAMPLES).parquet(src)
        query = jobs.write_batches(states.online_majority(stream, buckets=4), out, state)
        jobs.drain(query)
        held = [op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]]
        assert max(held) <= 5  # the buckets, and that of the samples without an item
    got = {(r.item, r.n_used): r.final_answer for r in spark.read.parquet(out).collect()}
    few = samples.where("item < 900")
    want = {(r.item, r.n_samples): r.final_answer if r.top_count * 2 > 5 else None
            for r in voting.early_stopped_vote(few).collect()}
    assert got == want | {(None, 2): "x", (900, 2): None}


def test_a_wave_is_one_batch(spark, tmp_path):
    rows = spark.range(0, 90, 1, 9)
    seen = []

    def run(stream):
        jobs.drain(jobs.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state"))
        seen.append(spark.read.parquet(f"{tmp_path}/out").count())

    live._arriving(rows, "id", str(tmp_path), run)
    assert seen == [30, 60, 90]
    assert spark.read.parquet(f"{tmp_path}/out").select("batch_id").distinct().count() == live.WAVES


@pytest.mark.parametrize("name", ["st3_online_elo", "st4_online_majority"])
def test_files_in_no_order(spark, tmp_path, name):
    for table in os.listdir(f"{ROOT}/sf0.001"):
        os.symlink(f"{ROOT}/sf0.001/{table}", tmp_path / table)
    # Votes of all times are in every file that Spark writes of these rows.
    os.unlink(tmp_path / "orders.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '{ROOT}/sf0.001/orders.parquet' ORDER BY hash(o_orderkey)) "
               f"TO '{tmp_path}/orders.parquet' (ROW_GROUP_SIZE 2048)")  # fmt: skip
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert compare(spark, load()[name], str(tmp_path)) is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
