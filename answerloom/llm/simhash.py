"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, checked distances, components.

Two 64-bit fingerprints that differ in at most two bits agree on at least two of four
16-bit blocks. Fingerprints are therefore joined on each of the six pairs of blocks and the
distance of what meets is counted. Exact copies never meet each other: they have one
fingerprint, which is one row from the first aggregation on.

A pair of blocks that very many different fingerprints share would make quadratically many
pairs. Beyond ``PAIRED`` fingerprints the partners meet another way, as exact: both ends of
a link reach one common value by flipping at most one bit each, outside the shared blocks.
Such rows are grouped by that value and linked to its smallest member.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm import near_copies
from answerloom.llm.common import fresh, id_and_text, slices, stored
from answerloom.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
BLOCKS = 4
PAIRED = 64
BATCH_BYTES = 4 << 20


def _fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = np.fromiter(map(digest, shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS
) -> DataFrame:
    """(doc_id, fp long) for every row; the 64 bits are kept in a signed long.

    A null or blank text has fingerprint zero; a text of fewer words than ``width`` is one
    shingle. Repeated rows give repeated rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([_fingerprint(t, width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def fingerprint_links(distinct: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b) links of a table of different fingerprints ``fp``, enough for its components.

    Blocks of at most ``paired`` fingerprints give every pair within ``MAX_DISTANCE``; the
    larger ones give, for every value that a fingerprint reaches by flipping at most one
    bit, a link to the smallest fingerprint that reaches it too. Both are real links, and
    any two linked fingerprints are connected by either.
    """
    size = 64 // BLOCKS
    masks = []
    for chosen in combinations(range(BLOCKS), BLOCKS - MAX_DISTANCE):
        mask = sum(((1 << size) - 1) << (size * b) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    blocks = F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(masks)
        ]
    )
    keyed = distinct.select("fp", F.explode(blocks).alias("k")).select("fp", "k.t", "k.key")
    counted = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A block's size travels with its rows; a block of one fingerprint ends here.
    keyed = stored(keyed.join(counted, ["t", "key"]), "blocks")
    small = keyed.where(F.col("n") <= paired)
    left = small.select("t", "key", F.col("fp").alias("a"))
    right = small.select("t", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near)
    flips = [0, *[1 << i if i < 63 else -(1 << 63) for i in range(64)]]
    free = F.array(*[F.array(*[F.lit(f) for f in flips if not f & m]) for m in masks])
    large = keyed.where(F.col("n") > paired)
    reach = large.select(
        "fp", F.explode(F.transform(free[F.col("t")], lambda f: F.col("fp").bitwiseXOR(f))).alias("via")
    ).distinct()
    least = reach.groupBy("via").agg(F.min("fp").alias("low"))
    stars = reach.join(least, "via").where(F.col("fp") > F.col("low"))
    return pairs.select("a", "b").unionAll(stars.select(F.col("low").alias("a"), F.col("fp").alias("b")))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``MAX_DISTANCE``
    differing bits. Texts without words share fingerprint zero and link like any other. A
    row without an id still carries links; a component of such rows only has a null
    ``component_id``. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    nodes = connected_components(fingerprint_links(classes.select("fp")), "a", "b")
    joined = classes.join(nodes, F.col("fp") == F.col("node"), "left")
    joined = joined.select("fp", "low", F.coalesce("component", "fp").alias("root"))
    names = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = near_copies.SHINGLE_WORDS,
    similarity: float = near_copies.SIMILARITY,
) -> DataFrame:
    """``docs`` without the rows whose component of near copies has a smaller id.

    Near copies share ``similarity`` of their ``width``-word shingles, which is counted on both
    texts; fingerprints play no part. One id stays of each component. Rows that repeat that id
    stay together (they are one document), and rows without an id stay because nothing can name
    them. All columns of ``docs`` are returned as they are.
    """
    groups = near_copies.near_copy_groups(docs, id_col, text_col, width, similarity)
    names = fresh(docs, "dropped_id"), fresh(docs, "dropped_text")
    gone = groups.where("doc_id > component_id").select(
        F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])
    )
    gone = near_copies.checked(stored(gone.distinct(), "gone"))
    same = F.xxhash64(docs[text_col].cast("string")) == F.col(names[1])
    return docs.join(gone, (docs[id_col] == F.col(names[0])) & same, "left_anti")
