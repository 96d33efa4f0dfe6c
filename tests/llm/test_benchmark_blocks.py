"""Benchmarks larger than one scan takes."""

import random
import string

import pytest

from answerloom.llm import decontaminate


def drawn(n, seed):
    return "".join(random.Random(seed).choices(string.ascii_lowercase, k=n))


@pytest.mark.parametrize("most", [250, 1000, 10_000])
def test_benchmark_in_blocks(spark, monkeypatch, most):
    rng = random.Random(3)
    items = [(i, " ".join(drawn(6, rng.random()) for _ in range(14))) for i in range(30)]
    items.append((99, drawn(600, 5)))
    rows = [(i, f"before {items[i % 31][1].upper()} and {items[i * 7 % 31][1]} after" if i % 3 else "clean text") for i in range(60)]
    rows += [(None, items[4][1]), (None, "clean"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect()), key=str)
    kept = sorted(map(tuple, decontaminate.drop_contaminated(docs, bench).collect()), key=str)
    assert len(one) >= 80 and len(kept) == 22
    monkeypatch.setattr(decontaminate, "MAX_ITEM_CHARS", most)
    blocks = list(decontaminate.item_blocks(bench))
    assert sorted(x for b in blocks for x in b) == sorted(items) and (len(blocks) > 1) == (most < 3000)
    assert all(len(b) == 1 or sum(len(t) for _, t in b) <= most for b in blocks)
    assert sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect()), key=str) == one
    assert sorted(map(tuple, decontaminate.drop_contaminated(docs, bench).collect()), key=str) == kept


def leftmost(text, item):
    places, at = [], text.find(item)
    while at >= 0:
        places.append((at, at + len(item), 0))
        at = text.find(item, at + len(item))
    return places


def test_short_items_match_exact_copies(spark):
    rng = random.Random(5)
    items = [(i, "".join(rng.choices("abc é", k=k))) for i, k in enumerate([2, 2, 3, 3, 4, 5, 6, 7, 7])]
    items += [(50, "aaa"), (51, "AAA"), (52, "b\tc"), (60, "  "), (61, ""), (62, None), (63, "the longer item of words")]
    texts = ["".join(rng.choices("abcABC é\n", k=rng.choice([0, 1, 5, 60, 900]))) for _ in range(60)]
    texts += ["aaaaaaa", "x" + items[8][1], "the longer item of words aaa", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = {t: t.lower().replace("\n", " ").replace("\t", " ") for t in [*texts, *(i for _, i in items)] if t is not None}
    short = [(key, plain[item]) for key, item in items if item and plain[item].strip() and len(item) < decontaminate.Q]
    want = sorted((i, key, *at) for i, t in enumerate(texts) if t for key, item in short for at in leftmost(plain[t], item))
    got = sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect()))
    assert [g for g in got if g[1] != 63] == want and len(want) > 100
    assert [g[0] for g in got if g[1] == 63] == [62]
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {g[0] for g in got}


def test_many_places_of_one_item(spark):
    """Every copy of an item is reported once, edited ones too, however many there are."""
    rng = random.Random(6)
    item = " ".join(drawn(6, rng.random()) for _ in range(12))
    edited = item[:20] + "#" + item[21:60] + item[61:]
    text = " -- ".join([item, edited] * 400)
    index = decontaminate.ItemIndex([(1, item)])
    found = index.matches([text])[0]
    assert len(found) == 800 and [f[3] for f in found] == [0, 2] * 400
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))
