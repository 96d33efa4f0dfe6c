"""Every query of the folder against plain Python over the whole smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from answerloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    return dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toPandas()


def test_secret_scan(spark, texts):
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ]
    got = rows(spark, "op1_secret_scan")
    assert set(got.doc_id) == set(texts)
    for r in got.itertuples():
        spans, counts = [], []
        for kind, (name, pattern, group, least) in enumerate(patterns):
            found = [m for m in pattern.finditer(texts[r.doc_id]) if len(m.group(group)) >= least]
            counts.append(len(found))
            spans += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in found]
        base = [s for _, _, s in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts)
        assert r.base_sha256 == sha(",".join(base))
        assert set(base) <= set(r.spans.split(","))


def test_quality(spark, texts):
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    got = rows(spark, "op2_quality")
    assert set(got.doc_id) == set(texts)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    joined = got.merge(labels, on="doc_id")
    assert (joined.predicted == joined.quality).mean() > 0.9


def test_substring_dedup(spark, texts):
    first = {}
    words = {i: WORD.findall(texts[i]) for i in sorted(texts)}
    for i, w in words.items():
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    got = rows(spark, "op3_substring_dedup")
    assert set(got.doc_id) == set(texts) and got.n_removed.sum() > 0
    for r in got.itertuples():
        w = words[r.doc_id]
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < r.doc_id:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), sha(kept))


def test_hilbert_shards(spark, texts):
    got = rows(spark, "op4_hilbert_shards")
    assert set(got.doc_id) == set(texts)
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    counts = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert list(counts.index) == list(range(24)) and counts["size"].max() - counts["size"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["size"] - 1).all()
    assert (counts["nunique"] == counts["size"]).all() and got.grown_shard.isna().all()


def test_simhash(spark, texts):
    def fingerprint(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    got = rows(spark, "op5_simhash")
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    component = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, prints, strict=True):
            for j, b in zip(ids, prints, strict=True):
                if (a ^ b).bit_count() <= 2 and component[j] < component[i]:
                    component[i] = component[j]
                    changed = True
    want = {i: (f"{f:016x}", component[i]) for i, f in zip(ids, prints, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == want


def test_decontamination(spark, texts):
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    want = {(i, k) for i, t in texts.items() for k, x in zip(items.item_id, items.text, strict=True) if x in t}
    got = rows(spark, "op6_decontamination")
    assert want and want == set(zip(got.doc_id, got.item_id, strict=True))


def test_embedding_dedup(spark):
    table = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    unit = np.stack(table.embedding).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = rows(spark, "op7_embedding_dedup").set_index("vec_id").loc[table.vec_id]
    assert (got.n_links.to_numpy() <= near.sum(axis=1)).all()
    assert got.n_links.sum() >= 0.9 * near.sum()
    assert (got.kept == (got.index == got.component_id)).all()


def test_token_store(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got = rows(spark, "op8_token_store").set_index("doc_id")
    start = 0
    for i in sorted(texts):
        ids = np.array(whole.encode(texts[i], add_special_tokens=False).ids + [2], dtype="<u4")
        r = got.loc[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_language_id(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = rows(spark, "op9_language_id").merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.95


def test_bpe(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    got = rows(spark, "op10_bpe")
    assert set(got.doc_id) == set(texts)
    for r in got.itertuples():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, name):
    from answerloom.catalog.registry import Entry
    from oracle import compare

    assert compare(spark, Entry(queries.QUERIES[name], queries.ORACLES[name]), FOLDER) is None
