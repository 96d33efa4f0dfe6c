"""Exact ranks of a column by narrowing value ranges, without sorting the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values that a range may hold when its rank is looked up in it.
SMALL_RANGE = 10_000
#: A sketch of a range is wrong by one part in this many of its values.
SKETCH_ACCURACY = 10_000


@dataclass
class RankRange:
    """Values strictly between ``low`` and ``high`` (None: open) hold the rank ``rank``."""

    rank: int
    inside: int
    below: int = 0
    low: Any = None
    high: Any = None
    done: bool = False
    value: Any = None
    stuck: bool = False

    def holds(self) -> Column:
        """Condition on ``v``."""
        kept = F.lit(True)
        if self.low is not None:
            kept = kept & (F.col("v") > F.lit(self.low))
        return kept if self.high is None else kept & (F.col("v") < F.lit(self.high))

    def sketch(self, accuracy: int) -> Column:
        """Two values that enclose the rank, or nearly so."""
        middle = (self.rank - self.below + 0.5) / self.inside
        ends = [min(max(middle + side * 2 / accuracy, 0.0), 1.0) for side in (-1, 1)]
        return F.percentile_approx(F.when(self.holds(), F.col("v")), ends, accuracy)

    def counts(self, ends: Sequence[Any]) -> Column:
        """How many values lie below, on, between, on and above the two ends."""
        v, (low, high) = F.col("v"), (F.lit(e) for e in ends)
        places = [v < low, v == low, (v > low) & (v < high), (v == high) & (v > low), v > high]
        return F.array(*[F.count_if(self.holds() & p) for p in places])

    def narrow(self, ends: Sequence[Any], counts: Sequence[int]) -> None:
        low, high = ends
        parts = [(self.low, low), low, (low, high), high, (high, self.high)]
        for part, n in zip(parts, counts):
            if self.rank < self.below + n:
                break
            self.below += n
        if isinstance(part, tuple):
            self.stuck = n == self.inside
            (self.low, self.high), self.inside = part, n
        else:
            self.done, self.value = True, part


def rank_ranges(
    values: DataFrame, ranks: Sequence[int], total: int, small: int, accuracy: int
) -> tuple[list[RankRange], int]:
    """Ranges of ``v`` for 0-based ranks, each known or at most ``small``, and the scans it took.

    A round sketches the values around every open rank and then counts exactly, so a sketch
    that is off costs another round and never the result. Only a few numbers a rank come
    back. Each round leaves about 4 / ``accuracy`` of a range, whatever the distribution.
    """
    ranges, scans = [RankRange(rank, total) for rank in ranks], 0
    while todo := [r for r in ranges if not r.done and not r.stuck and r.inside > small]:
        ends = values.agg(F.struct(*[r.sketch(accuracy).alias(f"r{i}") for i, r in enumerate(todo)]).alias("s"))
        ends = list(ends.first().s)
        found = values.agg(F.struct(*[r.counts(e).alias(f"r{i}") for i, (r, e) in enumerate(zip(todo, ends))]).alias("s"))
        for r, e, n in zip(todo, ends, found.first().s):
            r.narrow(e, n)
        scans += 2
    return ranges, scans


def values_at_ranks(
    df: DataFrame,
    column: str,
    fractions: Sequence[float],
    small: int = SMALL_RANGE,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """``(q, value)`` with the value at 0-based rank ``floor(q * n)`` of the sorted column.

    For numbers, dates and times. NULLs do not count; NaN is above all numbers; a rank
    beyond the last value, and any rank of an empty table, is NULL. Values that doubles
    cannot tell apart may share a last range of more than ``small`` values; it is exact too.
    """
    kind = df.select(column).schema[0].dataType
    schema = f"q double, value {kind.simpleString()}"
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    total = values.count()
    ranks = [(float(q), int(float(q) * total)) for q in fractions]
    inner = sorted({r for _, r in ranks if r < total})
    ranges, _ = rank_ranges(values, inner, total, small, accuracy)
    known = {r.rank: r.value for r in ranges if r.done}
    rows = [(q, known.get(r)) for q, r in ranks if r in known or r >= total]
    result = df.sparkSession.createDataFrame(rows, schema)
    rest = [r for r in ranges if not r.done]
    if not rest:
        return result
    spots = F.array_compact(F.array(*[F.when(r.holds(), F.lit(r.rank).cast("long")) for r in rest]))
    # Few values are left of a range; equal ones are one row.
    near = values.select("v", F.explode(spots).alias("rank")).groupBy("rank", "v").agg(F.count("*").alias("n"))
    below = F.create_map(*[F.lit(x).cast("long") for r in rest for x in (r.rank, r.below)])
    upto = F.sum("n").over(W.partitionBy("rank").orderBy("v")) + F.try_element_at(below, F.col("rank"))
    picked = near.withColumn("upto", upto).where("upto > rank").groupBy("rank").agg(F.min("v").alias("value"))
    asked = F.create_map(*[
        part for r in rest
        for part in (F.lit(r.rank).cast("long"), F.array(*[F.lit(q) for q, x in ranks if x == r.rank]))
    ])
    return result.unionAll(picked.select(F.explode(F.try_element_at(asked, F.col("rank"))).alias("q"), "value"))
