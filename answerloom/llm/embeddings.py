"""Near-duplicate vectors: sign hashes in several tables, exact cosines, components.

Each table hashes a vector to the signs of its products with random hyperplanes. Vectors
meet if all signs of a table agree; only then is their cosine computed, in double precision.
The signs grow with the logarithm of the number of vectors, so buckets stay small, and the
number of tables follows from the chance that a pair at the threshold meets in one of them.

Equal vectors are one vector with a count. A bucket of more than ``BUCKET`` vectors is dealt
to squares of smaller groups, each pair of groups in one task: all of its pairs are compared
all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import stored
from answerloom.llm.components import connected_components

THRESHOLD = 0.95
#: Chance that a pair exactly at the threshold is found; nearer pairs are likelier.
RECALL = 0.98
SEED = 7
BUCKET = 512


def table_shape(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs a table and number of tables for so many vectors."""
    bits = min(60, max(8, math.ceil(math.log2(max(rows, 2)))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def _sign_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) codes; the hyperplanes depend on the dimension only."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _hash(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("vector")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    mine = pa.array(np.flatnonzero(sizes == size))
                    flat = lists.take(mine).flatten().to_numpy(zero_copy_only=False)
                    codes = _sign_codes(_unit(flat.reshape(-1, int(size))), bits, tables)
                    ends = pa.array(np.arange(len(mine) + 1, dtype=np.int32) * tables)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c).take(mine) for c in ("rep", "vector")]
                        + [pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))],
                        ["rep", "vector", "codes"],
                    )

    return run


def _compare(threshold: float):
    def pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Pairs of one bucket, or of two groups of it, at or above the threshold."""
        first, second = key[3].as_py(), key[4].as_py()
        size, number = key[2].as_py(), key[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = _unit(vectors.reshape(-1, size))
        earlier = table.column("earlier").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        earlier = earlier.reshape(table.num_rows, number)
        group = table.column("own").to_numpy()
        rep = table.column("rep").to_numpy()
        left = np.flatnonzero(group == first)
        right = np.flatnonzero(group == second)
        found = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold - 1e-9)
            i, j = rows[i], right[j]
            once = rep[i] < rep[j] if first == second else rep[i] != rep[j]
            i, j = i[once], j[once]
            cosine = (unit[i] * unit[j]).sum(axis=1)
            # A pair that shares an earlier table's bucket was reported there.
            new = (cosine >= threshold) & ~(earlier[i] == earlier[j]).any(axis=1)
            found.append(np.column_stack([rep[i[new]], rep[j[new]]]))
        out = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return pairs


def vector_links(classes: DataFrame, rows: int, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """(a, b), each once, for pairs of different vectors (``rep``, ``vector``) that are linked."""
    bits, tables = table_shape(rows, threshold)
    size = F.size("vector").alias("size")
    hashed = stored(
        classes.mapInArrow(_hash(bits, tables), "rep long, vector array<double>, codes array<long>"), "codes"
    )
    keyed = hashed.select("rep", size, F.posexplode("codes").alias("number", "code"))
    counted = keyed.groupBy("number", "code", "size").agg(F.count("*").alias("n")).where("n > 1")
    # Only rows that meet another one carry their vector on.
    met = hashed.select("*", size, F.posexplode("codes").alias("number", "code"))
    met = met.join(counted, ["number", "code", "size"])
    groups = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("rep"), groups).cast("int")
    squares = F.transform(
        F.sequence(F.lit(0), F.col("groups") - 1),
        lambda g: F.struct(F.least(g, F.col("own")).alias("x"), F.greatest(g, F.col("own")).alias("y")),
    )
    met = met.withColumn("groups", groups).withColumn("own", own)
    met = met.select(
        "rep", "vector", "number", "code", "size", "own",
        F.slice("codes", F.lit(1), F.col("number")).alias("earlier"), F.explode(squares).alias("s"),
    ).select("*", "s.x", "s.y")
    return met.groupBy("number", "code", "size", "x", "y").applyInArrow(_compare(threshold), "a long, b long")


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows linked directly: equal vectors, and found pairs with a
    cosine of ``threshold`` or more. ``component_id`` is the smallest id reachable over
    links; ``kept`` marks its row. Vectors that are null, empty, zero, or hold a null or a
    number that is not finite link with nothing, and only vectors of one dimension link. A
    row without an id carries links but names no component. Repeated rows are equal vectors.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value; the vector itself is the grouping key.
    vector = F.transform("vector", lambda x: x + F.lit(0.0))
    good = rows.where(usable).select("vec_id", vector.alias("vector"))
    least = F.coalesce(F.min("vec_id"), F.lit(None).cast("long")).alias("low")
    classes = good.groupBy("vector").agg(least, F.count("*").alias("copies"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    links = stored(vector_links(classes.select("rep", "vector"), classes.count(), threshold), "links")
    nodes = connected_components(links, "a", "b")
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other"))
    ends = ends.unionAll(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    weights = classes.select(F.col("rep").alias("other"), "copies")
    degrees = ends.join(weights, "other").groupBy("rep").agg(F.sum("copies").alias("partners"))
    named = classes.join(degrees, "rep", "left").join(nodes, F.col("rep") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("component", "rep"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(names, "root").select(
        "vector", "component_id", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")
    )
    linked = good.join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = linked.unionAll(alone.toDF("vec_id", "n_links", "component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("vec_id").cast(kind), "n_links", "component_id", kept.alias("kept"))
