"""Hard negatives, repeated strings and conversation tries against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerloom.llm import negatives, queries, suffixes, turn_tries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def tuples(df, columns=None):
    got = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in got.collect()), key=repr)


# --- hard negatives ---------------------------------------------------------------------


def mined(rows, every=100, n=5):
    """(anchor, positive, rank, negative, scores) by comparing every pair."""
    good = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        good.append((vec_id, [math.floor(256 * float(x)) for x in vector], label))
    last = lambda i: math.inf if i is None else i
    out = []
    for k, (a, x, la) in enumerate(good):
        if a is None or a % every:
            continue
        scored = [
            (-sum(p * q for p, q in zip(x, y, strict=True)), last(b), b, lb == la)
            for j, (b, y, lb) in enumerate(good) if j != k and len(x) == len(y)
        ]
        scored.sort(key=lambda s: s[:2])
        for p, _, pid, _ in [s for s in scored if s[3]][:n]:
            below = [s for s in scored if not s[3] and 80 * -p <= 100 * -s[0] <= 100 * -p][:n]
            out += [(a, pid, r, s[2], -p, -s[0]) for r, s in enumerate(below, 1)]
    return sorted(out, key=repr)


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_query(spark):
    rows = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    want = mined(zip(rows.vec_id.tolist(), rows.embedding.tolist(), rows.label.tolist(), strict=True))
    assert want and tuples(queries.QUERIES["op11_hard_negatives"](spark, FOLDER), MINED) == want


def test_hard_negatives_edges(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0, 2.7]) for _ in range(11)], rng.randrange(3)) for i in range(160)]
    rows += rows[98:103]  # repeated rows, an anchor among them
    rows += [(None, rows[0][1], 1), (500, None, 1), (600, [], 1), (601, [], 2), (602, [], 1), (700, [math.nan] * 11, 0)]
    rows += [(800, [1.0] * 11, None), (900, [math.inf] * 11, 0), (1000, [1.0, None] * 5 + [1.0], 2), (300, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.withColumns({"row": F.lit(1), "id": F.lit("x"), "planes": F.lit(None).cast("int")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = negatives.whole_vectors(df, "vec_id", "embedding", label)
    for cell_rows in (8192, 37):
        got = negatives.hard_negatives(whole, F.col("id") % 100 == 0, cell_rows=cell_rows)
        assert tuples(got, MINED) == mined(rows)
    empty = negatives.whole_vectors(df.limit(0), "vec_id", "embedding", label)
    assert negatives.hard_negatives(empty, F.col("id") % 100 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e20], 1)], df.select("vec_id", "embedding", "label").schema)
    with pytest.raises(ValueError):
        negatives.hard_negatives(negatives.whole_vectors(large, "vec_id", "embedding", label), F.lit(True))


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for width, most in ((1, 1), (8, 127), (13, 5000), (64, 1 << 20)):
        a, b = rng.integers(-most, most + 1, (7, width)), rng.integers(-most, most + 1, (9, width))
        planes = negatives.bit_planes(b, most.bit_length() + 1)
        assert (negatives.scores(planes, negatives.subset_sums(a)) == b @ a.T).all()


# --- repeated strings -------------------------------------------------------------------


def cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(d), spans, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def test_repeated_strings_query(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    want = [
        (i, n, sum(b - a for a, b in spans), len(spans), sha(kept))
        for i, (n, spans, kept) in zip(docs.doc_id.tolist(), cut(docs.text.tolist(), 200), strict=True)
    ]
    got = queries.QUERIES["op12_suffix_dedup"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert tuples(got) == sorted(want, key=repr)


@pytest.mark.parametrize("length,hot", [(2, 4096), (7, 4096), (20, 4096), (20, 0), (20, 3), (40, 1)])
def test_repeated_strings_small(spark, length, hot):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 30)))
    shared = [word() * 2 for _ in range(12)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.4 else word() for _ in range(rng.randrange(12))) for _ in range(90)]
    texts += [texts[3], texts[3], None, "", "a" * 1000, "ab" * 300, "x" + "ab" * 290, "b" * length, "c" * (length + 1), "né" * 70]
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk long").withColumn("bucket", F.lit("z"))
    got = suffixes.remove_repeated_strings(docs.repartition(4), length=length, hot=hot)
    have = sorted(
        ((r.doc_id, r.n_bytes, [(s["first"], s["stop"]) for s in r.removed], bytes(r.kept)) for r in got.collect()), key=repr
    )
    assert have == sorted(((d, *c) for (d, _, _), c in zip(rows, cut(texts, length), strict=True)), key=repr)
    assert suffixes.remove_repeated_strings(docs.limit(0), length=length).count() == 0


def test_pieces_do_not_depend_on_the_order_of_rows():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(3000))) for _ in range(80)]
    made = []
    for _ in range(3):
        rng.shuffle(texts)
        table, ordered = suffixes._ordered(pa.table({"doc_id": list(range(80)), "text": texts}))
        assert table.column("text").to_pylist() == [t.decode() for t in ordered]
        chunk = suffixes._Chunk(ordered, 200)
        made.append((chunk.start.tolist(), chunk.key.tolist(), chunk.digest.tolist()))
    assert made[0] == made[1] == made[2]


def test_repeated_string_over_chunks(spark, monkeypatch):
    """Many chunks and buckets, repeats across block borders, one very long text."""
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(260)
    texts = [noise(rng.randrange(400)) + (passage if i % 3 == 0 else "") + noise(90) for i in range(120)]
    texts += [noise(65_500) + passage + noise(70_000), "z" * 70_000, "z" * 250]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted(((i, *c) for i, c in enumerate(cut(texts, 200))), key=repr)
    for name, value in (("CHUNK_BYTES", 20_000), ("KEY_BUCKET_BYTES", 30_000), ("PIECE_BUCKET_BYTES", 30_000)):
        monkeypatch.setattr(suffixes, name, value)
    for hot in (4096, 8):
        got = suffixes.remove_repeated_strings(docs, hot=hot).collect()
        have = [(r.doc_id, r.n_bytes, [(s["first"], s["stop"]) for s in r.removed], bytes(r.kept)) for r in got]
        assert sorted(have, key=repr) == want


# --- conversation tries -----------------------------------------------------------------


def trie(rows):
    """Node rows of the rebuilt conversations, node by node."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((-math.inf if turn is None else turn, role or "", text or ""))
    talks = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(talks.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])  # SQL's remainder
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * words
    return sorted(
        (
            (
                min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
                sha(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))),
            )
            for p, cs in members.items()
        ), key=repr,
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_trie_query(spark, folder):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    assert tuples(queries.QUERIES["op13_conversation_trie"](spark, folder), NODE) == trie(rows)


def test_trie_edges(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda n: rng.choice(["hello there", "one two three", "", "  ", "yes"])[: n + 9]
    rows = [(c, t, rng.choice(["user", "bot"]), say(t)) for c in range(70) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(3)]  # one path of many
    rows += [(401, t, "user", f"long {t % 3}") for t in range(400)] + [(402, t, "user", f"long {t % 3}") for t in range(390)]
    rows += [(210, None, None, None), (210, 2, "bot", "x y"), (211, None, "user", None), (-7, 1, "user", "minus"), (None, 1, "u", "none")]
    rows += [(500, 1, "user", "twice"), (500, 1, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = turns.withColumns({"depth": F.lit(9), "shard": F.lit("s"), "conv": F.lit(1), "p1": F.lit(None).cast("int")})
    monkeypatch.setattr(turn_tries, "LISTED", 7)
    rebuilt = turn_tries.rebuilt_turns(turn_tries.ordered_turns(turns))
    for piece, shard_turns in ((512, 100_000), (16, 60)):
        assert tuples(turn_tries.prefix_nodes(rebuilt, piece, shard_turns), NODE) == trie(rows)
    assert turn_tries.rebuilt_conversation_nodes(turns.limit(0)).count() == 0


def test_double_array_walks():
    rng = np.random.default_rng(2)
    paths = {tuple(rng.integers(1, 40, rng.integers(1, 6))) for _ in range(400)}
    nodes = {p[:d] for p in paths for d in range(len(p) + 1)}
    number = {p: i for i, p in enumerate(sorted(nodes, key=lambda p: (len(p), p)))}
    edges = np.array([(number[p[:-1]], p[-1], number[p]) for p in nodes if p])
    made = turn_tries.DoubleArray(*edges.T)
    seen = set()
    for p in nodes:
        state = np.zeros(1, np.int64)
        for c in p:
            state = made.step(state, np.array([c]))
        assert state[0] >= 0
        seen.add(int(state[0]))
        for c in range(1, 42):
            assert (made.step(state, np.array([c]))[0] >= 0) == ((*p, c) in nodes)
    assert len(seen) == len(nodes)
