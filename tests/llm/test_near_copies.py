"""The pipeline's near-duplicate stage against brute force over all pairs."""

import numpy as np
import pandas as pd

import corpus_pipeline
from answerloom.llm import near_copies

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def survivors(rows, similarity=0.8):
    """Ids that are the smallest of their component, comparing all pairs."""
    by_id = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in by_id.items():
        for x in s or {b""}:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in by_id}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in by_id.items():
        common = {}
        for x in s or {b""}:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if not s or n / (len(s) + len(by_id[j]) - n) >= similarity:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i for i in by_id if find(i) == i}


def edited_copies(rng, count, words=240, most=8):
    """Copies of one text with a few words replaced, of which some are similar and some not."""
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    for _ in range(count):
        copy = list(base)
        for at in rng.choice(words, int(rng.integers(1, most)), replace=False):
            copy[at] = f"x{rng.integers(0, 1 << 40)}"
        yield " ".join(copy)


def test_stage_on_given_documents(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, FOLDER).select("doc_id").collect()}
    assert got == survivors(zip(docs.doc_id, docs.text, strict=True))


def test_stage_on_planted_copies(spark):
    rng = np.random.default_rng(8)
    texts = list(edited_copies(rng, 150))
    for _ in range(30):
        texts += edited_copies(rng, 4, most=5)
    texts += ["", " ", None, "one two", "One  two", "three four"]
    rows = [(i, texts[k]) for i, k in enumerate(rng.permutation(len(texts)).tolist())]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = survivors(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, FOLDER).collect()}
    assert got == want and 40 < len(want) < len(rows) - 80
    for paired in (1, 10_000):
        groups = near_copies.near_copy_groups(table, paired=paired).where("doc_id = component_id")
        assert {r.doc_id for r in groups.collect()} == want


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(6)
    bands = near_copies.band_count(0.8)
    for _ in range(2000):
        drawn = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        a, b = drawn[:90], np.concatenate([drawn[:80], drawn[90:]])  # 80 of 100 in common
        assert set(near_copies.band_values(a, bands)) & set(near_copies.band_values(b, bands))


def test_rows_go_by_text_not_by_id(spark):
    rng = np.random.default_rng(9)
    copy, clean = (" ".join(f"w{i}" for i in rng.integers(0, 5000, 40)) for _ in range(2))
    rows = [(1, copy), (2, copy), (2, clean), (3, None), (4, None), (4, clean + " tail"), (None, copy)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, table, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3], rows[6]], key=str)
