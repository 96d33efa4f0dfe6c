"""Exact vector search, pooling and nearest prototypes.

Queries and prototypes are handed to the tasks in blocks of checked size; the big side is
read once per block and never shuffled. Each task keeps its own best hits per query, so
only ``k`` rows per query and task reach the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from answerloom.functions.common import col_of

# Query vectors handed to the tasks at once; the big side is scanned once for each block.
BLOCK_BYTES = 64 << 20
# Queries compared with a batch of the big side at once.
QUERY_SLICE = 1024


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two vectors of a row."""
    parts = F.zip_with(col_of(a), col_of(b), lambda x, y: (x - y).cast("double") * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """V4: cosine similarity, NULL when a vector has no length."""

    def dot(x: Column, y: Column) -> Column:
        parts = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    left, right = col_of(a), col_of(b)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.try_divide(dot(left, right), F.nullif(norm, F.lit(0.0)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"a vector is not of length {width}")
    return flat.reshape(len(column), width)


def _blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Query vectors in blocks of about ``BLOCK_BYTES``, as many as there are.

    A block is a hash share of the ids, so no sort is needed. Missing vectors are left out;
    vectors of different lengths are an error.
    """
    slim = queries.select(F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    slim = slim.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    total, low, high = slim.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not total:
        return
    if low != high:
        raise ValueError(f"query vectors have lengths from {low} to {high}")
    blocks = -(-total * high * 8 // BLOCK_BYTES)
    for number in range(max(1, blocks)):
        mine = slim.where(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == number)
        rows = sorted(mine.collect(), key=lambda r: (r["id"] is None, r["id"]))
        if rows:
            yield [r["id"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64)


def nearest(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    base_id: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """V1: the exact ``k`` nearest rows per query by squared distance, ties by id.

    When fewer than ``k`` rows exist, fewer come back. Rows and queries whose vector is
    missing or has a missing element are left out; another length stops the job. A task
    keeps ``k`` rows a query, which are ranked per query and then cut again.
    """
    id_type = base.schema[base_id].dataType.simpleString()
    q_type = queries.schema[query_id].dataType.simpleString()
    schema = f"{query_id} {q_type}, {base_id} {id_type}, distance double"
    found = None
    base = base.select(base_id, F.col(vector).cast("array<double>").alias(vector))
    base = base.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    for ids, block in _blocks(queries, query_id, query_vector):
        typed = pa.array(ids, type=to_arrow_type(queries.schema[query_id].dataType))
        part = base.select(base_id, vector).mapInArrow(_local_top_k(typed, block, k, schema), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = base.sparkSession.createDataFrame([], schema)
    order = W.partitionBy(query_id).orderBy("distance", base_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local_top_k(query_ids: pa.Array, block: np.ndarray, k: int, schema: str):
    names = [field.split(" ")[0] for field in schema.split(", ")]
    norms = (block * block).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = [np.empty(0, dtype=object)] * len(query_ids)
        best_dist = [np.empty(0)] * len(query_ids)
        ids_type = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids_type = batch.column(0).type
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _matrix(batch.column(1), block.shape[1])
            lengths = (rows * rows).sum(axis=1)
            for at in range(0, len(block), QUERY_SLICE):
                part = block[at : at + QUERY_SLICE]
                size = norms[at : at + QUERY_SLICE]
                rough = lengths[:, None] + size[None, :] - 2 * (rows @ part.T)
                # The rough form loses digits; whatever may be among the k is computed again.
                slack = 1e-12 * rows.shape[1] * (lengths.max() + size)
                bound = np.partition(rough, k - 1, axis=0)[k - 1] if len(rows) > k else np.inf
                near, which = np.nonzero((rough <= bound + 2 * slack).T)[::-1]
                starts = np.searchsorted(which, np.arange(len(part) + 1))
                for j in range(len(part)):
                    mine = near[starts[j] : starts[j + 1]]
                    exact = ((rows[mine] - part[j]) ** 2).sum(axis=1)
                    all_d = np.concatenate([best_dist[at + j], exact])
                    old, new = best_ids[at + j], ids[mine]
                    all_i = np.concatenate([old, new]) if len(old) else new
                    keep = np.lexsort((all_i, all_d))[:k]
                    best_dist[at + j], best_ids[at + j] = all_d[keep], all_i[keep]
        if ids_type is None:
            return
        for j in range(len(query_ids)):
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array([j] * len(best_dist[j]), type=pa.int32())),
                    pa.array(best_ids[j], type=ids_type),
                    pa.array(best_dist[j]),
                ],
                names=names,
            )

    return run


def nearest_to_one(
    base: DataFrame, query: Sequence[float], k: int, base_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """V1 for a single query, without Python: a distributed top-n over a column."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = base.select(base_id, squared_l2(vector, target).alias("distance"))
    return scored.orderBy("distance", base_id).limit(k)


def mean_pool(
    df: DataFrame, keys: Sequence[str], vector: str, dim: int, mask: Column | None = None
) -> DataFrame:
    """V3: element-wise mean of the vectors of each key, over unmasked rows only.

    A vector of another length than ``dim`` stops the job; missing vectors count for nothing.
    Elements are averaged in partial sums by key and place, so the plan is as small for
    4096 dimensions as for four.
    """
    rows = df if mask is None else df.where(mask)
    wrong = F.concat(F.lit("vector of length "), F.size(vector).cast("string"), F.lit(f", not {dim}"))
    fits = F.when(F.size(vector) == dim, True).otherwise(F.raise_error(wrong).cast("boolean"))
    parts = rows.where(F.col(vector).isNotNull()).where(fits)
    parts = parts.select(*keys, F.posexplode(vector).alias("__i", "__x"))
    means = parts.groupBy(*keys, "__i").agg(F.avg("__x").alias("__x"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__x")))
    means = means.groupBy(*keys).agg(F.transform(ordered, lambda e: e["__x"]).alias(vector))
    return means


def nearest_prototype(
    df: DataFrame,
    prototypes: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """V5: the prototype with the highest cosine per row; the first label wins ties.

    A row whose vector is missing, has a missing element or no length is like nothing.
    """
    id_type = df.schema[row_id].dataType.simpleString()
    label_type = prototypes.schema[label].dataType.simpleString()
    schema = f"{row_id} {id_type}, predicted {label_type}, similarity double"
    arrow_type = to_arrow_type(prototypes.schema[label].dataType)
    parts = []
    for labels, block in _blocks(prototypes, label, vector):
        scan = _best_cosine(pa.array(labels, type=arrow_type), block, row_id)
        whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
        usable = F.when(whole, F.col(vector)).otherwise(F.array_repeat(F.lit(0.0), block.shape[1]))
        parts.append(df.select(row_id, usable.alias(vector)).mapInArrow(scan, schema))
    if not parts:
        raise ValueError("no prototypes")
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # Most similar first, then the first label; a block without any match comes last.
    rank = F.struct(-F.coalesce("similarity", F.lit(-2.0)), "predicted")
    return found.groupBy(row_id).agg(
        F.min_by("predicted", rank).alias("predicted"), F.max("similarity").alias("similarity")
    )


def _best_cosine(labels: pa.Array, block: np.ndarray, row_id: str):
    # A prototype without length is like nothing: it can never be the best one.
    norms = np.linalg.norm(block, axis=1, keepdims=True)
    dead = norms[:, 0] == 0
    unit = block / np.where(norms > 0, norms, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _matrix(batch.column(1), block.shape[1])
            length = np.linalg.norm(rows, axis=1)
            scores = rows @ unit.T / np.where(length > 0, length, 1.0)[:, None]
            scores[:, dead] = -np.inf
            best = scores.argmax(axis=1)
            alive = (length > 0) & (not dead.all())
            top = scores[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    labels.take(pa.array(best, mask=~alive)),
                    pa.array(top, mask=~alive),
                ],
                names=[row_id, "predicted", "similarity"],
            )

    return run


def hit_payload(hits: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Payload rows of the hits; Spark picks the join by the size of the hits."""
    return payload.join(hits, key)


def context(hits: DataFrame, payload: DataFrame, key: str, query_id: str, text: str) -> DataFrame:
    """V7: the payload texts of each query joined by newlines in rank order (``k`` per query)."""
    rows = hit_payload(hits, payload, key)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda r: r["t"]), "\n")
    return rows.groupBy(query_id).agg(joined.alias("context"))


def add_vectors(existing: DataFrame | None, incoming: DataFrame, vector: str = "embedding") -> DataFrame:
    """V2: rows that are new by content; ids are a digest of the vector and the payload.

    A 256-bit digest keeps different rows apart at any table size.
    """
    named = [c for c in incoming.columns if c != "content_id"]
    content = F.sha2(F.to_json(F.struct(*named)), 256)
    fresh = incoming.withColumn("content_id", content).dropDuplicates(["content_id"])
    if existing is None:
        return fresh
    return fresh.join(existing.select("content_id"), "content_id", "left_anti")
