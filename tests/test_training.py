import pytest
from pyspark.sql import functions as F

from answerloom.functions import adapters
from answerloom.functions import prompts as P
from answerloom.functions import text as X
from answerloom.operators import filters, ordering, profiles, training


def test_examples_skip_invalid_rows(spark):
    rows = [(0, "1 + 1", "Add the ones.", "2"), (1, "2 + 2", "Oops", ""), (2, "3 + 3", None, "6")]
    df = spark.createDataFrame(rows, "i int, problem string, thinking string, content string")
    out = training.build_examples(df, ["i"], "problem", "thinking", "content", eos_id=7)
    good, bad = filters.split_valid(out, F.col("valid"))
    assert [r.i for r in good.collect()] == [0] and {r.i for r in bad.collect()} == {1, 2}
    row = good.first()
    assert row.token_ids[-1] == 7
    want = df.where("i = 0").select(X.token_count(P.prompt("problem", prompt="problem"))).first()[0]
    assert row.prompt_len == want


def test_distilled_answer(spark):
    df = spark.createDataFrame([("Reason carefully.", "The answer is 4."), ("<think>a</think>", " b "),
                                ("", "c"), ("x", " ")], "t string, c string")
    assert df.select(P.distilled_answer("t", "c")).first()[0] == "<think>Reason carefully.</think>\n\nThe answer is 4."
    plain = [r[0] for r in df.select(P.distilled_answer_plain("t", "c")).collect()]
    assert plain == ["Reason carefully.\n\nThe answer is 4.", "a\n\nb", "c", None]
    tagged = [r[0] for r in df.select(P.distilled_answer_plain("t", "c", True)).collect()]
    assert tagged[1:3] == ["<think>a</think>\n\nb", "<think></think>\n\nc"]


def test_prompt_text(spark):
    df = spark.createDataFrame([("Find x.\nGiven y.",)], "p string")
    got = df.select(P.prompt("problem", prompt="p")).first()[0]
    assert got == (
        "You are a helpful math assistant.\nAnswer the question and write the final result on a new line as:\n"
        "\\boxed{ANSWER}\n\nQuestion:\nFind x.\nGiven y.\n\nAnswer:"
    )


@pytest.fixture()
def examples(spark):
    rows = [(0, [1, 2, 3], 1), (1, [1, 2, 3, 4, 5], 2)]
    return spark.createDataFrame(rows, "i int, token_ids array<int>, prompt_len int")


def test_length_summary_and_filter(examples):
    size = F.size("token_ids")
    total = profiles.length_summary(examples, "i", size).first()
    assert tuple(total) == (4, 3, 0, 5, 1)
    answer = profiles.length_summary(examples, "i", size - F.col("prompt_len")).first()
    assert tuple(answer) == (2, 2, 0, 3, 1)
    assert [r.i for r in filters.length_filter(examples, size, 3).collect()] == [0]
    assert tuple(filters.length_filter_report(examples, size, 3).first()) == (2, 1, 1)


def test_padded_batch(examples):
    out = training.padded_batches(examples.withColumn("batch", F.lit(0)), pad_id=9).orderBy("i").collect()
    assert [r.input_ids for r in out] == [[9, 9, 1, 2], [1, 2, 3, 4]]
    assert [r.attn_mask for r in out] == [[False, False, True, True], [True] * 4]
    assert [r.labels for r in out] == [[-100, -100, 2, 3], [-100, 3, 4, 5]]
    assert [r.supervised for r in out] == [2, 3]


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    train, valid = ordering.train_validation_split(df, "k", 50)
    a, b = {r.k for r in train.collect()}, {r.k for r in valid.collect()}
    assert len(b) == 50 and not a & b and len(a | b) == 200
    again = {r.k for r in ordering.train_validation_split(df.repartition(7), "k", 50)[1].collect()}
    assert again == b
    with pytest.raises(ValueError):
        ordering.train_validation_split(df, "k", 200)


def test_chunks_rebuild_the_text(spark):
    texts = ["", "a", "é" * 2500 + "\n" + "𝄞x" * 300, "b" * 900, "c" * 901]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in [(1000, 100), (7, 0), (5, 4)]:
        got = {r.i: r.c for r in df.select("i", X.text_chunks("t", size, overlap).alias("c")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == [text[s : s + size] for s in range(0, len(text), size - overlap)]
    with pytest.raises(ValueError):
        X.text_chunks("t", 10, 10)


def test_long_conversation_comes_in_parts(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    whole = training.chat_prompts(df).first().prompt
    parts = training.chat_prompts(df, turns_per_part=3).orderBy("part").collect()
    assert len(parts) == 3 and "".join(p.prompt for p in parts) == whole
    assert whole.endswith("<|im_start|>assistant\n") and whole.count("<|im_start|>") == 8


def test_retry_and_backoff():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert adapters.with_retries(flaky, 5, 1.0, waits.append) == "ok"
    assert waits == [1.0, 2.0]
    assert adapters.backoff(10, 1.0) == 60.0
    with pytest.raises(ZeroDivisionError):
        adapters.with_retries(lambda: 1 / 0, 2, 0.0, waits.append)


def test_numbers_dates_and_choices(spark):
    money = {"$50,994": 50994.0, "€150,000": 150000.0, "12%": 12.0, "Age: 45": 45.0, "EUR 2,500": 2500.0,
             "1-2": None, "n/a": None, "": None, "-3.5": -3.5, "1.": 1.0}
    df = spark.createDataFrame(list(enumerate(money)), "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(X.parse_numeric("v")).collect()] == list(money.values())
    dates = spark.createDataFrame([("2024-02-27", 3), ("27.2.2024", 3)], "s string, n int")
    assert [str(r[0])[:10] for r in dates.select(X.end_date("s", "n")).collect()] == ["2024-03-01", "None"]
    judge = spark.createDataFrame([(0, "Score: 4"), (1, "12 of 5!"), (2, "none"), (3, "Score 45")], "i int, t string")
    assert [r[0] for r in judge.orderBy("i").select(X.judge_score("t")).collect()] == [4, 2, 3, 5]


def test_vectors(spark):
    from answerloom.operators import vectors

    rows = [(0, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.2]), (2, [0.9, 0.8, 0.7]), (3, [0.0, 0.0, 0.0])]
    base = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(7, [0.1, 0.2, 0.25])], "query_id int, embedding array<float>")
    hits = vectors.nearest(base, q, 2).orderBy("rank").collect()
    assert {(r.vec_id, round(r.distance, 4)) for r in hits} == {(0, 0.0025), (1, 0.0025)}
    assert vectors.nearest(base, q, 10).count() == 4  # fewer rows than k
    one = vectors.nearest_to_one(base, [0.1, 0.2, 0.25], 2).collect()
    assert {r.vec_id for r in one} == {0, 1}
    protos = base.where("vec_id in (1, 2)").withColumnRenamed("vec_id", "label")
    out = {r.vec_id: r.predicted for r in vectors.nearest_prototype(base, protos).collect()}
    assert out == {0: 1, 1: 1, 2: 2, 3: None}
    old = vectors.BLOCK_BYTES
    try:
        vectors.BLOCK_BYTES = 1
        split = {r.vec_id: r.predicted for r in vectors.nearest_prototype(base, protos).collect()}
        many = base.withColumnRenamed("vec_id", "query_id")
        rows = vectors.nearest(base, many, 1).collect()
    finally:
        vectors.BLOCK_BYTES = old
    assert split == out and {(r.query_id, r.vec_id) for r in rows} == {(i, i) for i in range(4)}
