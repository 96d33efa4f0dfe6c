"""Shards along a Hilbert curve over metadata.

Several metadata columns are quantised to a few bits each; the cell of a row gets its index
on the Hilbert curve through that grid. Rows in curve order are cut into runs. Neighbours on
the curve are neighbours in the grid, so a shard covers a small box of every dimension and
a filter on any of them skips most files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import fresh
from answerloom.plans.skew import global_positions

BITS = 6


def category_cell(column: Column, bits: int = BITS) -> Column:
    """Cell of a categorical value: a hash, so any number of values fits; null is a value."""
    value = F.coalesce(F.xxhash64(column.cast("string")), F.lit(0))
    return F.when(column.isNull(), 0).otherwise(F.pmod(value, F.lit(1 << bits))).cast("int")


def magnitude_cell(column: Column, bits: int = BITS) -> Column:
    """Cell of a size: its quarter octave, from the integer alone. Null and below 1 are 0."""
    whole = F.greatest(F.coalesce(column.cast("long"), F.lit(0)), F.lit(0))
    digits = F.length(F.bin(whole))
    quarter = F.when(digits > 2, F.shiftright(whole, 0)).otherwise(F.shiftleft(whole, 2))
    # The two binary digits after the first one.
    lead = F.conv(F.substring(F.concat(F.bin(quarter), F.lit("00")), 2, 2), 2, 10).cast("int")
    return F.when(whole < 1, 0).otherwise(F.least((digits - 1) * 4 + lead, F.lit((1 << bits) - 1))).cast("int")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of an (n, dimensions) array of cells."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = np.int64(1 << (bits - 1))
    q = top
    while q > 1:  # undo the rotations and reflections of each level, from the top
        low = q - 1
        for i in range(n):
            inverted = (x[i] & q) != 0
            x[0] ^= np.where(inverted, low, 0)
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code across dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def hilbert_column(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Curve index of a row; the cells must lie in [0, 2**bits) and fit 62 bits together."""
    if len(cells) * bits > 62:
        raise ValueError("at most 62 bits in all dimensions together")

    def index(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            grid = np.array(cells.tolist(), dtype=np.int64)
            yield pd.Series(hilbert_index(grid, bits) if len(grid) else [], dtype="int64")

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from index(batches)

    return F.pandas_udf(typed, "long")(F.array(*cells))


def cut_runs(
    df: DataFrame, cells: Sequence[Column], order: Sequence[Column], shards: int, bits: int = BITS
) -> DataFrame:
    """Add ``curve``, ``shard`` and ``slot``: equal runs of the curve order.

    Shard ``s`` has the rows ranked from ``ceil(s*n/shards)`` up to the next such rank, so
    row counts differ by one at most; slots count from 0 in a shard. ``order`` breaks ties
    within a cell; rows equal in it too take their places in no fixed order. Ranks come from
    a range partitioning, so a cell with a third of all rows spreads over many tasks. An
    empty table stays empty. Columns of these names already there are refused.
    """
    for name in ("curve", "shard", "slot"):
        if fresh(df, name) != name:
            raise ValueError(f"the table has a column {name} already")
    marked = df.withColumn("curve", hilbert_column(cells, bits))
    rank = fresh(marked, "rank")
    ranked = global_positions(marked, [F.col("curve"), *order], rank)
    total = ranked.count()
    place = F.col(rank)
    shard = F.floor(place * shards / F.lit(max(total, 1))) if total * shards < 1 << 50 else None
    if shard is None:  # beyond exact doubles
        shard = F.expr(f"cast(`{rank}` as decimal(38,0)) * {shards} div {total}")
    shard = shard.cast("int")
    first = F.expr(f"cast((cast({{}} as decimal(38,0)) * {total} + {shards - 1}) div {shards} as long)".format("shard"))
    return ranked.withColumn("shard", shard).withColumn("slot", place - first).drop(rank)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder a shard, rows by slot: the files' statistics follow the curve."""
    spread = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").parquet(path)
