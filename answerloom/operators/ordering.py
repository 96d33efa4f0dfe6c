"""Positions, row blocks, shards and set operations over row identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.plans.skew import group_positions, null_safe_join


def row_blocks(
    df: DataFrame, order: Sequence[Column], size: int = 500, keys: Sequence[str] = (), **plan
) -> DataFrame:
    """Consecutive blocks of ``size`` rows, per key or over the table; adds pos, block."""
    placed = group_positions(df, keys, order, "pos", **plan)
    return placed.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def stride_shards(df: DataFrame, order: Sequence[Column], world: int) -> DataFrame:
    """Row i goes to shard ``i mod world``."""
    placed = group_positions(df, (), order, "pos")
    return placed.withColumn("shard", (F.col("pos") % world).cast("int"))


def rows_of_both(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Left rows also present on the right; left duplicates stay."""
    return left.join(right.select(row_id), row_id, "left_semi")


def rows_of_either(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Rows of both sets, the same row once."""
    extra = right.join(left.select(row_id), row_id, "left_anti")
    return left.unionByName(extra)


def union_headers(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their headers."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def train_validation_split(
    df: DataFrame, row_id: str, validation_size: int = 50, seed: int = 123
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``validation_size`` rows for validation, chosen by a seeded hash order.

    The order is the MD5 digest of seed and id, largest first, ties by id. Only the id and
    its count travel: rows that share an id are numbered within it, and the last id chosen
    gives just as many rows as are still wanted. A missing id is an id like any other.
    """
    total = df.count()
    if not 1 <= validation_size < total:
        raise ValueError("validation_size must be between 1 and the row count - 1")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))
    ids = df.groupBy(row_id).agg(F.count("*").alias("__n"))
    ids = ids.orderBy(shuffled.desc(), F.col(row_id)).limit(validation_size)
    order = W.orderBy(shuffled.desc(), F.col(row_id)).rowsBetween(W.unboundedPreceding, -1)
    room = F.lit(validation_size) - F.coalesce(F.sum("__n").over(order), F.lit(0))
    quota = ids.withColumn("__quota", room).where("__quota > 0").drop("__n")
    marked = null_safe_join(df, quota, [row_id], "left")
    place = F.row_number().over(W.partitionBy(row_id).orderBy(*[F.col(c) for c in df.columns]))
    chosen = marked.where("__quota IS NOT NULL").withColumn("__place", place)
    validation = chosen.where(F.col("__place") <= F.col("__quota")).select(*df.columns)
    beyond = chosen.where(F.col("__place") > F.col("__quota")).select(*df.columns)
    train = marked.where("__quota IS NULL").select(*df.columns).unionAll(beyond)
    return train, validation
