"""Ordered series: moving averages, trends, nucleus and top-k cuts, softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.functions.common import float_divide
from answerloom.functions.text import parse_numeric
from answerloom.plans.skew import (
    null_safe_join,
    SEGMENT_ROWS,
    group_positions,
    running,
    trailing_sums,
    with_group_stats,
)


def _exact(value: Column, decimals: int | None) -> Column:
    """Sum in decimals when the scale is known, so the result does not depend on the order."""
    return value.cast("double") if decimals is None else value.cast(f"decimal(28,{decimals})")


def moving_average(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[Column],
    value: str,
    window: int,
    decimals: int | None = None,
    segment_rows: int = SEGMENT_ROWS,
    **plan,
) -> DataFrame:
    """Trailing mean over a fixed number of rows; a window of 1 or less changes nothing."""
    width = max(window, 1)
    placed = group_positions(df, series, order, "pos", **plan)
    summed = trailing_sums(
        placed, series, "pos", {"__s": _exact(F.col(value), decimals)}, width, segment_rows
    )
    n = F.least(F.col("pos") + 1, F.lit(width))
    return summed.withColumn("smoothed", F.col("__s").cast("double") / n).drop("__s")


def moving_average_fraction(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[Column],
    value: str,
    fraction: float = 0.25,
    decimals: int | None = None,
    segment_rows: int = SEGMENT_ROWS,
    **plan,
) -> DataFrame:
    """Trailing mean whose window is a fraction of the series length, at least one row.

    Prefix sums are built segment by segment; the sum before the window comes from an
    equi-join on (series, position), which has one row per key.
    """
    placed = group_positions(df, series, order, "pos", **plan)
    sized = with_group_stats(placed, series, {"__n": F.count("*")})
    width = F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.col("__n"))).cast("long")
    prefix = running(
        sized.withColumn("__w", width),
        series,
        "pos",
        {"__cs": ("sum", _exact(F.col(value), decimals))},
        segment_rows=segment_rows,
    ).drop("__n")
    before = prefix.select(
        *series, (F.col("pos") + F.col("__w")).alias("pos"), F.col("__cs").alias("__before")
    )
    joined = null_safe_join(prefix, before, [*series, "pos"], "left")
    total = F.col("__cs") - F.coalesce(F.col("__before"), F.lit(0))
    n = F.least(F.col("pos") + 1, F.col("__w"))
    return joined.withColumn("smoothed", total.cast("double") / n).drop("__cs", "__before", "__w")


def trend_by_group(
    df: DataFrame,
    groups: Sequence[str],
    metrics: Sequence[str],
    at: str,
    tie: str,
) -> DataFrame:
    """First and last value of each metric per group, for groups with two points or more."""
    when = F.struct(F.col(at), F.col(tie))
    wide = df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        *[F.min_by(m, when).cast("double").alias(f"__f_{m}") for m in metrics],
        *[F.max_by(m, when).cast("double").alias(f"__l_{m}") for m in metrics],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"__f_{m}").alias("first_value"),
                F.col(f"__l_{m}").alias("last_value"),
            )
            for m in metrics
        ]
    )
    tall = wide.where(F.col("n") >= 2).select(*groups, "n", F.inline(rows))
    return tall.withColumn("trend", _direction("Improving", "Declining", "Stable"))


def _direction(up: str, down: str, flat: str) -> Column:
    return (
        F.when(F.col("last_value") > F.col("first_value"), up)
        .when(F.col("last_value") < F.col("first_value"), down)
        .otherwise(flat)
    )


def table_trend(df: DataFrame, metrics: Sequence[str], at: str, tie: str) -> DataFrame:
    """The trend of each numeric column over the whole table; missing dates sort first."""
    when = F.struct(F.col(at), F.col(tie))
    numbers = {m: parse_numeric(m) for m in metrics}
    picks = [
        F.struct(
            F.lit(m).alias("metric"),
            F.min_by(n, when).alias("first_value"),
            F.max_by(n, when).alias("last_value"),
            F.min_by(F.col(at).cast("string"), when).alias("first_at"),
            F.max_by(F.col(at).cast("string"), when).alias("last_at"),
        )
        for m, n in numbers.items()
    ]
    rows = df.agg(F.array(*picks).alias("p")).select(F.inline("p"))
    return rows.withColumn("trend", _direction("increased", "decreased", "remained stable"))


def epoch_bounds(df: DataFrame, epoch: str, step: str) -> DataFrame:
    """First, last and middle step of every epoch."""
    return df.groupBy(epoch).agg(
        F.min(step).alias("first_step"),
        F.max(step).alias("last_step"),
        ((F.min(step) + F.max(step)) / 2).alias("midpoint"),
    )


def nucleus(
    df: DataFrame,
    rows: Sequence[str],
    item: str,
    p: str,
    top_p: float | None,
    segment_rows: int = SEGMENT_ROWS,
    **plan,
) -> DataFrame:
    """Per row keep the most probable items while the mass before them is below ``top_p``.

    The first item always stays; the kept mass is renormalised. ``None`` or 1 and above
    keep everything as it is.
    """
    if top_p is None or top_p >= 1.0:
        return df.withColumn("share", F.col(p))
    placed = group_positions(df, rows, [F.col(p).desc(), F.col(item)], "__pos", **plan)
    massed = running(
        placed, rows, "__pos", {"__before": ("sum", F.col(p))}, exclusive=True,
        segment_rows=segment_rows,
    )
    kept = massed.where((F.col("__pos") == 0) | (F.coalesce(F.col("__before"), F.lit(0.0)) < top_p))
    stats = with_group_stats(kept.drop("__before"), rows, {"__mass": F.sum(p)})
    share = F.col(p) / F.greatest(F.col("__mass"), F.lit(1e-12))
    return stats.withColumn("share", share).drop("__mass", "__pos")


def top_k_share(df: DataFrame, rows: Sequence[str], item: str, p: str, k: int) -> DataFrame:
    """The ``k`` largest items per row, renormalised; where their mass is zero shares are NaN.

    The rank limit is applied on both sides of the shuffle (a group limit).
    """
    rank = F.row_number().over(W.partitionBy(*rows).orderBy(F.col(p).desc(), F.col(item)))
    kept = df.withColumn("__rn", rank).where(F.col("__rn") <= k).drop("__rn")
    stats = with_group_stats(kept, rows, {"__mass": F.sum(p)})
    share = float_divide(F.col(p).cast("double"), F.col("__mass").cast("double"))
    return stats.withColumn("share", share).drop("__mass")


def softmax(
    df: DataFrame, rows: Sequence[str], value: str, temperature: float = 1.0
) -> DataFrame:
    """Temperature softmax over each row, shifted by the row maximum."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    shifted = with_group_stats(df, rows, {"__top": F.max(value)})
    weighted = shifted.withColumn(
        "__e", F.exp((F.col(value) - F.col("__top")) / F.lit(float(temperature)))
    )
    stats = with_group_stats(weighted, rows, {"__sum": F.sum("__e")})
    return stats.withColumn("share", F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")
