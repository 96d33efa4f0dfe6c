"""The skew-safe ways give the rows of the plain ways."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.operators import sequences, voting
from answerloom.operators.joins import joined_terms_in_text, literal_terms_in_text
from answerloom.plans import skew


@pytest.fixture(scope="module")
def rows(spark):
    # One key owns more than a third of the rows.
    df = spark.range(0, 600).withColumn("k", F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 7))
    v = (F.col("id") * 37 % 101).cast("double")
    return df.select("k", "id", v.alias("v")).repartition(5)


def keyed(df, *cols):
    return {r.id: tuple(r[c] for c in cols) for r in df.select("id", *cols).collect()}


def close(a, b):
    return a.keys() == b.keys() and all(x == pytest.approx(b[k]) for k, x in a.items())


def test_global_positions(spark, rows):
    got = keyed(skew.global_positions(rows, [F.col("v").desc(), F.col("id")]), "pos")
    plain = rows.withColumn("pos", F.row_number().over(W.orderBy(F.col("v").desc(), "id")) - 1)
    assert got == keyed(plain, "pos")


def test_group_positions(spark, rows):
    order = [F.col("v").desc(), F.col("id")]
    small = skew.group_positions(rows, ["k"], order)
    split = skew.group_positions(rows, ["k"], order, max_window_rows=10)
    assert keyed(small, "pos") == keyed(split, "pos")


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("segment", [1, 7, 1000])
def test_running(spark, rows, exclusive, segment):
    placed = skew.group_positions(rows, ["k"], [F.col("id")])
    got = skew.running(
        placed, ["k"], "pos",
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v"))},
        exclusive=exclusive, segment_rows=segment,
    )
    w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    want = placed.select(
        "*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.min("v").over(w).alias("n")
    )
    a, b = keyed(got, "s", "m", "n"), keyed(want, "s", "m", "n")
    assert {k: (s or 0, m, n) for k, (s, m, n) in a.items()} == {
        k: (s or 0, m, n) for k, (s, m, n) in b.items()
    }


@pytest.mark.parametrize("width", [1, 4, 30])
def test_moving_average_segments(spark, rows, width):
    args = (rows, ["k"], [F.col("id")], "v", width)
    whole = keyed(sequences.moving_average(*args), "smoothed")
    cut = sequences.moving_average(*args, segment_rows=5, max_window_rows=10)
    assert close(keyed(cut, "smoothed"), whole)


def test_moving_average_fraction(spark, rows):
    args = (rows, ["k"], [F.col("id")], "v", 0.25)
    whole = keyed(sequences.moving_average_fraction(*args, decimals=2), "smoothed")
    cut = sequences.moving_average_fraction(*args, decimals=2, segment_rows=3, max_window_rows=10)
    assert close(keyed(cut, "smoothed"), whole)


def test_moving_average_golden(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 3.0, 5.0, 7.0])], "k int, id int, v double")
    half = sequences.moving_average_fraction(df, ["k"], [F.col("id")], "v", 0.5)
    assert keyed(half, "smoothed") == {0: (1.0,), 1: (2.0,), 2: (4.0,), 3: (6.0,)}
    none = sequences.moving_average_fraction(df, ["k"], [F.col("id")], "v", 0.0)
    assert keyed(none, "smoothed") == {0: (1.0,), 1: (3.0,), 2: (5.0,), 3: (7.0,)}


def test_nucleus(spark):
    p = [[0.5, 0.4, 0.1, 0.0, 0.0], [0.40, 0.30, 0.20, 0.10, 0.0], [0.05, 0.25, 0.35, 0.15, 0.20]]
    data = [(r, i, x) for r, xs in enumerate(p) for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "r int, i int, p double")
    out = sequences.nucleus(df, ["r"], "i", "p", 0.6)
    first = {x.i: x.share for x in out.where("r = 0").collect()}
    assert first == pytest.approx({0: 0.5555556, 1: 0.4444444})
    cut = sequences.nucleus(df, ["r"], "i", "p", 0.6, segment_rows=1, max_window_rows=1)
    shares = lambda d: {(x.r, x.i): x.share for x in d.collect()}
    assert shares(cut) == pytest.approx(shares(out))
    sums = {x.r: x.s for x in out.groupBy("r").agg(F.sum("share").alias("s")).collect()}
    assert sums == pytest.approx({0: 1.0, 1: 1.0, 2: 1.0})
    assert sequences.nucleus(df, ["r"], "i", "p", 1.0).where("share <> p").count() == 0


def test_softmax_rejects_zero_temperature(spark, rows):
    with pytest.raises(ValueError):
        sequences.softmax(rows, ["k"], "v", 0.0)


def test_early_stop_segments(spark):
    data = [(1, i, a) for i, a in enumerate("aabba" "aabbb")] + [(2, i, a) for i, a in enumerate("abc")]
    df = spark.createDataFrame(data, "item int, sample_idx int, answer string")
    whole = voting.samples_until_majority(df)
    cut = voting.samples_until_majority(df, segment_rows=2)
    as_set = lambda d: {tuple(r) for r in d.select("item", "sample_idx", "answer").collect()}
    assert as_set(whole) == as_set(cut)
    assert as_set(whole) == set(data)  # 5 of 10 is no majority, so nothing is cut
    won = df.withColumn("answer", F.when(F.col("sample_idx") < 7, "a").otherwise(F.col("answer")))
    assert {x[1] for x in as_set(voting.samples_until_majority(won, segment_rows=2)) if x[0] == 1} == set(range(6))


def test_term_lookup_both_ways(spark):
    texts = ["The cat sat on a mat", "concatenation théorie", "", "a long multi-word phrase here\nand more", "xyz"]
    terms = ["cat", "a", "multi-word phrase", "concatenation", "théorie", "here\nand", "missing", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(i, t) for i, x in enumerate(texts) for t in terms if t in x.lower()}
    joined = joined_terms_in_text(df, "id", "text", table, "term")
    literal = literal_terms_in_text(df, "id", "text", terms)
    assert [tuple(r) for r in joined.collect()].__len__() == len(want)
    assert {tuple(r) for r in joined.collect()} == want
    assert {tuple(r) for r in literal.collect()} == want


MISSING = [(None, i, float(i)) for i in range(8)] + [("a", i, float(i * i)) for i in range(8)]


def test_running_and_moving_average_with_missing_keys(spark):
    from answerloom.operators.sequences import moving_average_fraction
    from answerloom.plans.skew import running

    df = spark.createDataFrame(MISSING, "k string, pos long, v double").repartition(3)
    want = {(k, i): sum(v for kk, j, v in MISSING if kk == k and j <= i) for k, i, _ in MISSING}
    for rows in (3, 100):
        out = running(df, ["k"], "pos", {"s": ("sum", F.col("v"))}, segment_rows=rows).collect()
        assert {(r.k, r.pos): r.s for r in out} == want
        smooth = moving_average_fraction(df, ["k"], [F.col("pos")], "v", 0.25, segment_rows=rows)
        got = {(r.k, r.pos): r.smoothed for r in smooth.collect()}
        assert [got[None, i] for i in range(8)] == [0.0, 0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5]


def test_term_lookup_with_repeated_and_missing_keys(spark):
    from answerloom.operators.joins import terms_in_text

    rows = [(1, "the wandering river"), (1, "the wandering river"), (None, "Wandering"), (2, None), (2, "ab")]
    texts = spark.createDataFrame(rows, "k int, text string")
    terms = spark.createDataFrame([("wandering",), ("Wandering ",), ("ab",), ("river",), (None,), ("",)], "term string")
    ways = [
        sorted((tuple(r) for r in terms_in_text(texts, "k", "text", terms, "term", max_literal_terms=n).collect()), key=str)
        for n in (0, 200)
    ]
    want = [(1, "river")] * 2 + [(1, "wandering")] * 2 + [(2, "ab"), (None, "wandering")]
    assert ways[0] == ways[1] == sorted(want, key=str)


def test_term_lookup_in_blocks(spark):
    from answerloom.operators.joins import joined_terms_in_text

    texts = spark.createDataFrame([(i, f"alpha{i} beta gamma") for i in range(20)], "k int, text string")
    terms = spark.createDataFrame([(f"alpha{i}",) for i in range(20)] + [("gamma",)], "term string")
    ways = [
        sorted(tuple(r) for r in joined_terms_in_text(texts, "k", "text", terms, "term", max_term_chars=n).collect())
        for n in (10, 10_000)
    ]
    assert ways[0] == ways[1] and len(ways[0]) == 20 + 20 + 10


def test_bradley_terry_rates_a_missing_arena_on_both_sides(spark):
    from answerloom.operators.boards import bradley_terry

    votes = [(a, w, l) for a in ("x", None) for w, l in [("m1", "m2"), ("m2", "m3"), ("m1", "m3"), ("m3", "m1")]]
    df = spark.createDataFrame(votes, "arena string, winner string, loser string")
    ways = [
        {(r.arena, r.model): round(r.rating, 6) for r in bradley_terry(df, max_pairs=n, steps=5).collect()} for n in (1, 100)
    ]
    assert ways[0] == ways[1] and len(ways[0]) == 6


def test_whole_prompts_by_default(spark):
    from answerloom.operators.training import chat_prompts

    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(1500)], "conv_id int, turn int, role string, text string")
    assert chat_prompts(turns).count() == 1


def test_deep_text_is_an_error(spark):
    from answerloom.functions.nested import response_fields

    raw = '{"choices":[{"message":{"content":{"text":{"text":{"text":{"text":{"text":"deep"}}}},"value":"ok"}}}]}'
    got = spark.createDataFrame([(raw,)], "raw string").select(response_fields("raw").alias("r")).first().r
    assert got.error == "too deep" and got.content is None


def test_checks_hold_when_columns_are_pruned(spark, tmp_path):
    import pytest

    from answerloom.operators.evaluate import match_predictions
    from answerloom.sources.readers import read_records, record_fields

    truth = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    made = spark.createDataFrame([(1, "a"), (3, "b")], "k int, p string")
    with pytest.raises(Exception, match="unmatched record"):
        match_predictions(truth, made, "k").groupBy("t").count().collect()
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    for way in (None, True):
        with pytest.raises(Exception, match="invalid JSON"):
            read_records(spark, str(tmp_path), json_lines=way).count()
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"b": 2}\n')
    with pytest.raises(Exception, match="missing key"):
        record_fields(read_records(spark, str(tmp_path)), ["a"]).count()


def test_json_tables_of_a_folder_share_their_columns(spark, tmp_path):
    from answerloom.sources.readers import read_json_table, read_metric_log

    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('[{"a": 1}]')
    (tmp_path / "j" / "2.json").write_text('[{"b": 2, "a": 3}]')
    rows = read_json_table(spark, str(tmp_path / "j"))
    assert rows.columns == ["a", "b"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", ""), ("3", "2")]
    (tmp_path / "m.csv").write_text("step,loss\n1,0.5\n,0.25\n")
    log = read_metric_log(spark, str(tmp_path / "m.csv"), "step long, loss double").collect()
    assert [(r.step, r.loss) for r in log] == [(1, 0.5), (None, 0.25)]


def test_vectors_of_another_length_stop_and_zero_prototypes_never_win(spark):
    import pytest

    from answerloom.operators.vectors import mean_pool, nearest_prototype

    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, None), (1, [3.0, 2.0])], "k int, embedding array<double>")
    assert mean_pool(df, ["k"], "embedding", 2).first().embedding == [2.0, 2.0]
    with pytest.raises(Exception, match="vector of length 2"):
        mean_pool(df, ["k"], "embedding", 3).count()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id int, embedding array<double>")
    protos = spark.createDataFrame([(0, [0.0, 0.0]), (1, [-1.0, 0.0])], "label int, embedding array<double>")
    got = {r.vec_id: (r.predicted, r.similarity) for r in nearest_prototype(rows, protos).collect()}
    assert got == {1: (1, -1.0), 2: (None, None)}


def test_split_takes_exactly_n_rows_of_repeated_ids(spark):
    from answerloom.operators.ordering import train_validation_split

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (None, "f")], "k int, v string")
    for n in range(1, 6):
        train, valid = train_validation_split(df, "k", n)
        assert valid.count() == n and train.count() == 6 - n
        assert sorted(r.v for r in train.unionAll(valid).collect()) == list("abcdef")


def test_nearest_with_missing_equal_and_split_vectors(spark, monkeypatch):
    import numpy as np

    from answerloom.operators import vectors

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((60, 3)) + 1e4, np.tile(np.array([[1e4, 1e4, 1e4]]), (8, 1))])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [1.0, None, 2.0])]
    base = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points[:10])] + [(77, None)], "query_id int, embedding array<double>")
    want = {}
    for q in range(10):
        d = ((points - points[q]) ** 2).sum(axis=1)
        want[q] = np.lexsort((np.arange(len(d)), d))[:4].tolist()
    for size in (vectors.BLOCK_BYTES, 50):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", size)
        got = vectors.nearest(base, queries, 4).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want and len(got) == 40
    import pytest

    with pytest.raises(Exception, match="not of length 3"):
        vectors.nearest(base.unionAll(base.limit(1).selectExpr("vec_id", "array(1.0D)")), queries, 4).count()


def test_multi_reward_advantage_is_two_normalisations(spark):
    import numpy as np

    from answerloom.operators.rollouts import STD_GUARD, multi_reward_advantage

    rng = np.random.default_rng(9)
    rows = [(g, float(a), float(b)) for g in (1, 2) for a, b in rng.integers(0, 3, (6, 2))]
    rows += [(3, 1.0, 1.0), (None, 0.0, 1.0), (None, 1.0, 0.5), (4, 1.0, 2.0), (4, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "prompt_id int, x double, y double")
    got = sorted((tuple(r) for r in multi_reward_advantage(df, {"x": 1.0, "y": 0.5}).collect()), key=str)
    want = []
    for g in {r[0] for r in rows}:
        mine = np.array([r[1:] for r in rows if r[0] == g])
        if len(mine) == 1:
            want += [(g, *mine[0].tolist(), None)]
            continue
        norm = (mine - mine.mean(axis=0)) / (mine.std(axis=0, ddof=1) + STD_GUARD)
        total = norm @ np.array([1.0, 0.5])
        final = (total - total.mean()) / (total.std(ddof=1) + STD_GUARD)
        want += [(g, *m, f) for m, f in zip(mine.tolist(), final.tolist(), strict=True)]
    want = sorted(want, key=str)
    assert [g[:3] for g in got] == [tuple(w[:3]) for w in want]
    assert all(a == b or abs(a - b) < 1e-9 for a, b in zip([g[3] for g in got], [w[3] for w in want], strict=True))


def test_distinct_counts_in_one_scan(spark):
    from answerloom.operators.profiles import distinct_counts

    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (None, "b", None)], "x int, y string, z string")
    out = distinct_counts(df, ["x", "y", "z"], threshold=1)
    assert {r.column: (r.n, r.many) for r in out.collect()} == {"x": (2, True), "y": (2, True), "z": (0, False)}
