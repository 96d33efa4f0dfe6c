"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerloom.llm import (
    bpe, components, decontaminate, embeddings, language, quality, queries, secrets, sharding,
    simhash, substrings, token_store,
)
from answerloom.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp long"
PROSE = "the quiet river ran below the old stone bridge while children threw pebbles and counted rings "
LONG = " ".join(f"word{i % 997} alpha{i % 89}," for i in range(60_000))
ROWS = [
    (1, PROSE * 3, "en", "a", 1, 0.5, "x", 9), (2, PROSE * 3, "en", "a", 1, 0.5, "x", 9),
    (2, PROSE * 3, "en", "a", 1, 0.5, "x", 9), (3, None, None, None, None, None, None, None),
    (None, PROSE, "en", None, 5, None, None, None), (4, "", "en", "b", 0, None, None, None),
    (5, LONG, "en", "b", len(LONG), None, None, None), (6, " \t\n ", None, "b", 4, None, None, None),
    (7, "12 34 !!", "xx", "c", 8, None, None, None), (8, "Wörter für <|endoftext|> dich", "de", "c", 3, None, None, None),
    (None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_secrets(docs, nothing, spark):
    assert sorted_ids(secrets.secret_report(docs)) == ALL_IDS
    assert secrets.secret_report(nothing).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in secrets.secret_report(docs).where("doc_id = 3").collect()} == {empty}
    key = "q8Zt4Lw9Xc2Vb7Nm5Ka1Js6D"
    text = f"token=secret: password='abcdefghijkl' é auth header {key} end secret aaaaaaaaaaaaaaaaaaaa1"
    one = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    report = secrets.secret_report(one).first()
    assert (report.n_assign, report.n_access, report.n_hex) == (1, 0, 1)
    novel = [s for s in report.spans.split(",") if s.startswith("novel")]
    start = text.index(key)
    assert novel == [f"novel:{start}:{start + len(key)}"]
    assert [r.found for r in secrets.secret_spans(one).where("kind = 'novel'").collect()] == [key]
    clean = secrets.redact_secrets(one).first()
    assert key not in clean.text and "[novel]" in clean.text and clean.n_chars == len(clean.text)
    assert secrets.redact_secrets(docs).columns == docs.columns


def test_quality(docs, nothing, spark):
    good = [(i, f"{PROSE} chapter {i} of the long story", 1) for i in range(60)]
    bad = [(100 + i, "BUY NOW!! " * 30 + str(i), 0) for i in range(60)]
    labelled = spark.createDataFrame([*good, *bad, (None, None, 1), (7, PROSE, None)], "doc_id long, text string, label int")
    model = quality.fit_quality(labelled)
    name = "score_1"
    scored = quality.score_quality(docs, model, name=name)
    assert scored.columns == [*docs.columns, name] and sorted_ids(scored) == ALL_IDS
    assert all(0 <= r[0] <= 1 for r in scored.select(name).collect())
    same = {r[0] for r in scored.where("doc_id IN (1, 2)").select(name).collect()}
    assert len(same) == 1 and same.pop() > 0.5
    with pytest.raises(ValueError):
        quality.score_quality(docs, model)
    assert quality.drop_low_quality(docs, model).columns == docs.columns
    assert quality.score_quality(nothing, model, name=name).count() == 0
    unlearned = quality.fit_quality(labelled.where("label = 1"))
    assert {r[0] for r in quality.score_quality(docs, unlearned, name=name).select(name).collect()} == {0.5}
    first, second = ([r[0] for r in quality.score_quality(labelled, m).orderBy("doc_id").select("score").collect()]
                     for m in (model, quality.fit_quality(labelled.repartition(5))))
    assert np.allclose(first, second)


def test_substrings(docs, nothing, spark):
    got = {r.doc_id: r for r in substrings.remove_repeated_windows(docs).where("doc_id IS NOT NULL").collect()}
    assert sorted_ids(substrings.remove_repeated_windows(docs)) == ALL_IDS
    words = len(PROSE.split()) * 3
    assert got[1].removed == [] and [(s.first, s.stop) for s in got[2].removed] == [(0, words)]
    assert got[3].n_words == 0 and got[4].kept == "" and got[5].kept == LONG
    unnamed = substrings.remove_repeated_windows(docs).where("doc_id IS NULL AND n_words > 0").first()
    assert [(s.first, s.stop) for s in unnamed.removed] == [(0, words // 3)]
    assert substrings.remove_repeated_windows(nothing).count() == 0


def test_substrings_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_DOCUMENTS", 5)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 50)
    rng = np.random.default_rng(3)
    passages = [[f"p{k}w{i}" for i in range(20)] for k in range(6)]
    rows = []
    for i in range(60):
        words = [f"d{i}x{j}" for j in range(int(rng.integers(0, 30)))]
        for k in rng.integers(0, 6, 2):
            words += passages[k][int(rng.integers(0, 5)) :]
        rows.append((i, " ".join(words)))
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    got = {r.doc_id: r.kept for r in substrings.remove_repeated_windows(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        assert got[i] == " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_sharding(docs, nothing, spark):
    cells = [sharding.category_cell(F.col("lang")), sharding.magnitude_cell(F.col("n_chars"))]
    cut = sharding.cut_runs(docs, cells, [F.col("doc_id")], 4)
    assert sorted_ids(cut) == ALL_IDS
    counts = {r["shard"]: r["count"] for r in cut.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.cut_runs(nothing, cells, [F.col("doc_id")], 4).count() == 0
    with pytest.raises(ValueError):
        sharding.cut_runs(docs.withColumn("slot", F.lit(1)), cells, [F.col("doc_id")], 4)
    path = scratch_path(spark, "shards")
    sharding.write_shards(cut, path)
    assert spark.read.parquet(path).count() == len(ROWS)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_walk(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_magnitude_cell(spark):
    rows = spark.createDataFrame([(v,) for v in (None, -3, 0, 1, 2, 3, 4, 5, 6, 7, 8, 1 << 40)], "v long")
    got = [r[0] for r in rows.select(sharding.magnitude_cell(F.col("v"))).collect()]
    assert got[:3] == [0, 0, 0] and got[-1] == 63 and got[3:-1] == sorted(got[3:-1])


def test_simhash(docs, nothing):
    groups = simhash.simhash_groups(docs)
    assert sorted_ids(groups) == ALL_IDS
    got = {r.doc_id: r.component_id for r in groups.where("doc_id IS NOT NULL").collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == got[6] == 3
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted_ids(kept) == [1, 3, 5, 7, 8, None, None]
    assert simhash.simhash_groups(nothing).count() == 0


def test_simhash_links_agree_on_both_sides_of_the_switch(spark):
    rng = np.random.default_rng(5)
    prints = set()
    for base in rng.integers(0, 1 << 62, 4).tolist():
        for _ in range(40):
            flips = rng.choice(64, int(rng.integers(0, 4)), replace=False)
            value = base
            for f in flips.tolist():
                value ^= 1 << f
            prints.add(value - (1 << 64) if value >> 63 else value)
    table = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    parts = []
    for paired in (1, 8, 10_000):
        links = simhash.fingerprint_links(table, paired)
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
        parts.append({tuple(r) for r in components.connected_components(links, "a", "b").collect()})
    assert parts[0] == parts[1] == parts[2]
    near = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert near == {tuple(sorted(r)) for r in simhash.fingerprint_links(table, 10_000).distinct().collect()}


def test_components(spark):
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    pairs += [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    want = {x: find(x) for x in parent}
    table = spark.createDataFrame([*pairs, *pairs[:50], (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(table, "a", "b").collect()}
    assert got == want
    assert components.connected_components(table.limit(0), "a", "b").count() == 0


def test_decontamination(docs, nothing, spark):
    item = "A narrow passage between two cliffs leads down to the harbour where grey boats wait for the tide."
    edited = item.replace("narrow", "narow").replace("boats", "boots")
    rows = [
        (1, "Before. " + item + " After."), (2, "x " * 40 + edited.upper() + " y"), (3, item[:40] + " other words " + item[60:]),
        (4, None), (5, ""), (None, item), (6, LONG + " " + item.replace(" ", "\n") + LONG), (1, "Before. " + item + " After."),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, None), (7, "short"), (9, "")], "item_id long, text string")
    found = decontaminate.benchmark_matches(table, items)
    got = sorted(((r.doc_id, r.start_pos, r.end_pos, r.edits) for r in found.collect()), key=str)
    at = len(LONG) + 1
    assert got == sorted(
        [(1, 8, 8 + len(item), 0)] * 2 + [(2, 80, 79 + len(item), 2), (None, 0, len(item), 0), (6, at, at + len(item), 0)], key=str
    )
    assert sorted_ids(decontaminate.drop_contaminated(table, items)) == [3, 4, 5]
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
    assert decontaminate.benchmark_matches(nothing, items).count() == 0
    assert decontaminate.benchmark_matches(table, items.limit(0)).count() == 0


def test_banded_distance_is_the_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 3, int(rng.integers(1, 12)))
        b = rng.integers(0, 3, int(rng.integers(0, 14)))
        row = [0] * (len(b) + 1)
        for i in range(1, len(a) + 1):
            new = [i]
            for j in range(1, len(b) + 1):
                new.append(min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[-1] + 1))
            row = new
        got = decontaminate.banded_distance(a, b, -20, 20, 100)
        assert got[0] == min(row)


def test_embeddings(spark):
    base = [1.0, 0.5, -0.25, 2.0]
    rows = [
        (1, base), (2, base), (2, base), (3, [2 * x for x in base]), (4, [1.0, 0.5, -0.25, 2.01]), (5, [-x for x in base]),
        (6, None), (7, []), (8, [0.0] * 4), (9, [1.0, None, 2.0, 3.0]), (10, [float("nan"), 1.0, 1.0, 1.0]),
        (11, [float("inf"), 1.0, 1.0, 1.0]), (12, base[:3]), (None, base), (13, [1e200 * x for x in base]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit(3))
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(table).collect()), key=str)
    linked = {1, 2, 3, 4, 13, None}
    assert len(got) == len(rows)
    for vec, n, component, kept in got:
        assert (n, component) == ((6, 1) if vec in linked else (0, vec))
        assert kept == (vec is not None and vec == component)
    assert embeddings.near_duplicate_vectors(table.limit(0)).count() == 0


def test_embedding_recall_and_split_buckets(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    points = np.concatenate([centres[rng.integers(0, 40, 500)] + 0.16 * rng.standard_normal((500, 32)), np.tile(centres[:1], (50, 1))])
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(table).collect()}
    found = np.array([got[i] for i in range(len(points))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()
    classes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points[:500])], "rep long, vector array<double>")
    sizes = [sorted(tuple(sorted(r)) for r in embeddings.vector_links(classes, 500, bucket=b).collect()) for b in (3, 512)]
    assert sizes[0] == sizes[1] and len(set(sizes[0])) == len(sizes[0])


def test_token_store(docs, nothing, spark):
    ranks = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    whole = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    odd = ["a  b", " lead", "trail ", "a \n b\n\n c", "x  y", "tab\t tab", "it's we'll  ", "<|endoftext|>x", "é è", "a\x1cb c", "\n", "  ", "12 345 ...", ""]
    encode = token_store.piece_encoder(ranks, (("<|endoftext|>", 50256),))
    for text in [*odd, *(r[1] for r in ROWS if r[1])]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(docs, path, ranks, (("<|endoftext|>", 50256),), end_id=2)
    read = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    stream = np.frombuffer(b"".join(r.ids for r in read), "<u4")
    assert [r.start for r in read] == [0, *np.cumsum([r.n_tokens for r in read])[:-1].tolist()]
    wanted = [0, 1, 2, len(stream) - 1, len(stream) // 2, 77_777, 77_777, len(stream) + 5, None, -4]
    positions = spark.createDataFrame([(p,) for p in wanted], "position long")
    got = {r.position: r.token for r in token_store.read_positions(spark, path, positions).collect()}
    assert got == {p: int(stream[p]) for p in wanted if p is not None and 0 <= p < len(stream)}
    token_store.write_tokens(nothing, empty := scratch_path(spark, "tokens"), ranks)
    assert token_store.read_documents(spark, empty).count() == 0


def test_direct_codes():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [255, 256], [2**32 - 1, 0, 65_536], rng.integers(0, 70_000, 5000).tolist(), [300] * 1025):
        codes = token_store.DirectCodes(token_store.pack(np.array(ids, dtype=np.uint32)))
        assert codes.all().tolist() == ids and len(codes) == len(ids)
        assert [codes[i] for i in range(len(ids))] == ids
    with pytest.raises(ValueError):
        token_store.DirectCodes(b"none")


def test_language(docs, nothing, spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    rows = [(PROSE, "en"), ("der alte Fluss floss unter der steinernen Brücke", "de"), (None, "en"), ("x", None)]
    model = language.fit_language(spark.createDataFrame(rows, "text string, lang string"), path)
    assert model.languages == ("de", "en")
    got = language.identify(docs, model)
    assert sorted_ids(got) == ALL_IDS
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got.where("doc_id IS NOT NULL").collect()}
    assert by_id[1][0] == "en" and 0.5 < by_id[1][1] <= 1
    assert by_id[3] == by_id[4] == by_id[6] == by_id[7] == ("und", 0.0)
    assert language.identify(nothing, model).count() == 0
    nobody = language.fit_language(spark.createDataFrame([], "text string, lang string"), path)
    assert {r.lang_pred for r in language.identify(docs, nobody).collect()} == {"und"}


def test_forward_sums_every_segmentation():
    pieces = language.pieces_of(queries.tokenizer_file("piece_bpe_32k.model"))
    chance = np.append(pieces.prior, 0.0)[:, None]
    for word in ("▁the", "▁bridge", "▁żółw", "▁qqq"):
        place = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                code = pieces._codes(np.array([[ord(c) for c in word[i:j]]], dtype=np.uint64), 0, j - i)
                k = int(pieces.find(code)[0])
                place[i, j] = k if k >= 0 or j > i + 1 else pieces.count - 1

        def total(i, word=word, place=place):
            if i == len(word):
                return 1.0
            return sum(pieces.prior[k] * total(j) for (a, j), k in place.items() if a == i and k >= 0)

        steps, n = pieces.lattice([word])
        assert np.isclose(language.forward(steps, n, chance)[0][0, 0], np.log(total(0)))
        counts = language.expected_counts(pieces, [word], np.ones(1), chance)
        lengths = {k: j - i for (i, j), k in place.items()}
        assert np.isclose(sum(counts[k] * lengths[k] for k in np.flatnonzero(counts)), len(word))


def test_long_words_and_long_pieces(monkeypatch):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    pieces = language.pieces_of(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    assert pieces.longest == max(map(len, (k for k in known if not k.startswith("<")))) > 12
    chance = np.random.default_rng(4).random((pieces.count + 1, 3))
    chance[-1] = 0.0
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choices(sorted("abcdefghiżó漢"), k=k)) for k in (1, 2, 15, 16, 17, 64, 255, 256, 257, 700)]
    words += ["▁internationalparticularly", "▁" + "responsibilities" * 20, "▁" + "a" * 600]
    monkeypatch.setattr(language, "LONG_BLOCK", 40)
    for word in words:
        together = language.forward(*pieces.lattice([word]), chance)[0][0]
        assert np.allclose(language.long_forward(pieces, word, chance), together)
        first = chance[:, :1]
        counts = language.expected_counts(pieces, [word], np.full(1, 2.5), first)
        assert np.allclose(language.long_counts(pieces, word, 2.5, first), counts)
    # The same model and answers, whether words count as long or not.
    held = language._Scorer(language.LanguageModel(path, ("a", "b", "c"), np.log(chance[:-1].T)))
    texts = [" ".join(words[i:]).encode() for i in range(len(words))]
    one = held.texts(texts)
    monkeypatch.setattr(language, "LONG_WORD", 3)
    other = language._Scorer(language.LanguageModel(path, ("a", "b", "c"), np.log(chance[:-1].T))).texts(texts)
    assert np.allclose(one, other)


def test_bpe(docs, nothing):
    path = queries.tokenizer_file("word_bpe_49k.json")
    whole = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    merges = bpe.PairIndexEncoder(path)
    odd = ["aaaa aaa aa", "Hello  <|endoftext|>World's 12é", "x<|startoftext|><|endoftext|>", "é ﬁ Ǆ İ", "a b c", "🙂🙂 naïve", "a\x1cb", "<|ENDOFTEXT|>", "we'll  they've 'S"]
    for text, ids in zip(odd, merges.encode([t.encode() for t in odd]), strict=True):
        got = np.frombuffer(ids, "<i4")
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        assert merges.decode(got) == whole.decode(got.tolist(), skip_special_tokens=False)
    decoded = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert sorted_ids(decoded) == ALL_IDS
    for r in decoded.where("doc_id IN (3, 4, 6)").collect():
        assert (r.ids, r.decoded) == ([], "")
    assert sorted(decoded.collect(), key=str) == sorted(bpe.round_trip_documents(docs, path).collect(), key=str)
    assert bpe.encode_documents(nothing, path).count() == 0


def test_pipeline_stages(docs, nothing, spark):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, nothing, sf).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted_ids(last(spark, docs, sf)) == ALL_IDS and last(spark, nothing, sf).count() == 0
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    documents = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert ids < documents and len(ids) > 0.6 * len(documents)
