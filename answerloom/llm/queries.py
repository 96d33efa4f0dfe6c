"""The registered queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import (
    bpe, decontaminate, embeddings, language, near_copies, negatives, quality, secrets, sharding,
    simhash, substrings, suffixes, token_store, turn_tries,
)
from answerloom.llm.common import held_out, table
from answerloom.session import scratch_path

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def tokenizer_file(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def quality_model(spark: SparkSession, folder: str, docs: DataFrame) -> quality.QualityModel:
    """Fitted on the labelled rows outside the held-out fifth."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    # Labels that may be sent go to the texts, which then stay where they are.
    return quality.fit_quality(rows.join(near_copies.checked(labels), "doc_id"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_model(spark, folder, docs)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeated_windows(table(spark, folder, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["first"])
    return cut.select(
        "doc_id", "n_words", length.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


SHARDS = 24


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    cells = [
        sharding.category_cell(F.col("lang")),
        sharding.category_cell(F.col("source")),
        sharding.magnitude_cell(F.col("size")),
    ]
    cut = sharding.cut_runs(rows, cells, [F.col("doc_id"), F.col("text_crc32")], SHARDS)
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_matches(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, folder, "embeddings"))


END_ID = 2


def op8_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(
        table(spark, folder, "documents"), path, tokenizer_file("byte_bpe_50k.tiktoken"),
        special=(("<|endoftext|>", 50256),), end_id=END_ID,
    )
    read = token_store.read_documents(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    model = language.fit_language(docs.where(~held), tokenizer_file("piece_bpe_32k.model"))
    found = language.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    coded = bpe.round_trip_documents(table(spark, folder, "documents"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = negatives.whole_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", moved)
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixes.remove_repeated_strings(table(spark, folder, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["first"])
    return cut.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turn_tries.rebuilt_conversation_nodes(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_store": op8_token_store,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

#: SQL exists where neither a checksum nor a model nor merges are in the way.
ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
          g AS (SELECT doc_id, i, array_to_string(a[i:i+12], ' ') AS s
            FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w)),
          f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
          gone AS (SELECT DISTINCT doc_id, i + k AS j FROM (
            SELECT doc_id, i, unnest(range(13)) AS k FROM g JOIN f USING (s) WHERE low < doc_id)),
          l AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
          sha256(coalesce(array_to_string(list_filter(a, lambda x, j: js IS NULL OR NOT list_contains(js, j)), ' '), ''))
            AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)""",
    "op11_hard_negatives": """
        WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
          s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
              CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
          p AS (SELECT anchor_id, id, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
          n AS (SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score,
              s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE r <= 5""",
    "op7_embedding_dedup": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
          links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
          reach AS (SELECT vec_id AS node, vec_id AS other FROM e
            UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
          n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(other) AS component_id,
          e.vec_id = min(other) AS kept
        FROM reach LEFT JOIN n ON n.vec_id = reach.node JOIN e ON e.vec_id = reach.node GROUP BY e.vec_id""",
}
