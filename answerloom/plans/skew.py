"""Plan shapes that hold when one key owns a large part of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The helpers here use
partial aggregation and joins that adaptive execution can split, or cut a key into
ordered segments of bounded size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.session import reliable_checkpoint

SEGMENT_ROWS = 1_000_000
MAX_WINDOW_ROWS = 5_000_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a missing key equals a missing key; the keys of ``left`` stay."""
    marks = {f"__j{i}": key for i, key in enumerate(keys)}
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(m) for m, k in marks.items()], *others)
    match = F.lit(True)
    for mark, key in marks.items():
        match = match & left[key].eqNullSafe(renamed[mark])
    return left.join(renamed, match, how).drop(*marks)


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row.

    The statistics are aggregated map-side first, then joined back; a hot key becomes a
    skewed join side, which adaptive execution splits over several tasks.
    """
    stats = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    marks = {f"__k{i}": key for i, key in enumerate(keys)}
    stats = stats.select(*[F.col(k).alias(m) for m, k in marks.items()], *aggs)
    match = None
    for mark, key in marks.items():
        same = df[key].eqNullSafe(stats[mark])
        match = same if match is None else match & same
    return df.join(stats, match, "inner").drop(*marks)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group; one aggregation over the key columns only."""
    counted = df.groupBy(*keys).count() if keys else df.groupBy().count()
    return counted.agg(F.max("count")).first()[0] or 0


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """0-based rank of every row in a total order, without a single-task window.

    Rows are range-partitioned and sorted; the partition offsets are a table with one row
    per partition. The ranged rows are checkpointed because range bounds are sampled and
    must not change between the offset pass and the numbering pass.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = reliable_checkpoint(ranged.withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", _LOCAL_BITS)
    local = F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(part.alias("__part"))
        .count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    )
    numbered = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col("__off") + local).drop("__part", "__off", "__mid")


def group_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "pos",
    max_window_rows: int | None = MAX_WINDOW_ROWS,
) -> DataFrame:
    """0-based rank inside each group.

    Groups that all fit in one task use a window. Otherwise rows are ranked globally by
    (keys, order) and the group's first rank is subtracted. Finding out costs one pass over
    the keys; a caller who knows that groups are small passes ``None`` and saves it.
    """
    if not keys:
        return global_positions(df, order, name)
    if max_window_rows is None or largest_group(df, keys) <= max_window_rows:
        window = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    ranked = global_positions(df, [*[F.col(k).asc() for k in keys], *order], "__gpos")
    ranked = with_group_stats(ranked, keys, {"__first": F.min("__gpos")})
    return ranked.withColumn(name, F.col("__gpos") - F.col("__first")).drop("__gpos", "__first")


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    outputs: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Running sum / max / min / xor over a dense position, one bounded segment per task.

    ``pos`` is an integer order column that is unique inside a group; ``pos div
    segment_rows`` is the segment. Each segment is scanned alone; totals of the earlier
    segments come from a small table. ``exclusive`` leaves the current row out.
    """
    cut = df.withColumn("__seg", F.floor(F.col(pos) / F.lit(segment_rows)).cast("long"))
    end = -1 if exclusive else 0
    inside = W.partitionBy(*keys, "__seg").orderBy(pos).rowsBetween(W.unboundedPreceding, end)
    earlier = W.partitionBy(*keys).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__seg").agg(
        *[_COMBINE[kind][0](col).alias(f"__t_{name}") for name, (kind, col) in outputs.items()]
    )
    carried = totals.select(
        *keys,
        "__seg",
        *[
            _COMBINE[kind][0](F.col(f"__t_{name}")).over(earlier).alias(f"__c_{name}")
            for name, (kind, _) in outputs.items()
        ],
    )
    # Only groups that reach a second segment carry anything; the rest match nothing here.
    carried = carried.where(F.col("__seg") > 0)
    local = cut.select(
        "*",
        *[
            _COMBINE[kind][0](col).over(inside).alias(f"__l_{name}")
            for name, (kind, col) in outputs.items()
        ],
    )
    joined = null_safe_join(local, carried, [*keys, "__seg"], "left")
    for name, (kind, _) in outputs.items():
        joined = joined.withColumn(
            name, _COMBINE[kind][1](F.col(f"__l_{name}"), F.col(f"__c_{name}"))
        )
    return joined.drop(
        "__seg", *[f"__l_{n}" for n in outputs], *[f"__c_{n}" for n in outputs]
    )


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    width: int,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Sum over the current row and the ``width - 1`` rows before it.

    Rows near a segment end are repeated into the next segment as a halo, so every
    segment is complete on its own.
    """
    segment_rows = max(segment_rows, width)
    seg = F.floor(F.col(pos) / F.lit(segment_rows)).cast("long")
    tail = F.col(pos) >= (seg + 1) * segment_rows - (width - 1)
    homes = F.when(tail & F.lit(width > 1), F.array(seg, seg + 1)).otherwise(F.array(seg))
    spread = df.withColumn("__own", seg).withColumn("__seg", F.explode(homes))
    window = W.partitionBy(*keys, "__seg").orderBy(pos).rowsBetween(-(width - 1), 0)
    summed = spread.select(
        "*", *[F.sum(col).over(window).alias(name) for name, col in values.items()]
    )
    return summed.where(F.col("__seg") == F.col("__own")).drop("__seg", "__own")
