"""Column profiles, roles, counts and distribution summaries.

Profiles run as one wide aggregation over the table: no row is multiplied by the number
of columns, and each task sends a single partial row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.functions.common import is_blank, plain_number, strip
from answerloom.functions.text import token_count
from answerloom.operators.selection import values_at_ranks
from answerloom.plans.skew import global_positions, running

# fixed values: shares above which a column counts as numeric or as a date
NUMERIC_SHARE = 0.5
DATE_SHARE = 0.3
ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, T.StringType):
        return plain_number(F.col(column))
    return F.lit(None).cast("double")


def _is_date(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).isNotNull()
    if isinstance(kind, T.StringType):
        text = F.col(column)
        return text.rlike(ISO_DATE) & F.try_to_timestamp(strip(text)).isNotNull()
    return F.lit(False)


def _one_row_to_table(wide: DataFrame) -> DataFrame:
    """Turn a single row of structs into one row per column."""
    return wide.select(F.inline(F.array(*[F.col(f"`{c}`") for c in wide.columns])))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A1: count, sum, avg, min, max of the plain numbers of every column; others are left out."""
    stats = []
    for c in columns or df.columns:
        n = _number(df, c)
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(n).alias("count"),
                F.sum(n).alias("sum"),
                F.avg(n).alias("avg"),
                F.min(n).alias("min"),
                F.max(n).alias("max"),
            ).alias(c)
        )
    return _one_row_to_table(df.agg(*stats)).where(F.col("count") > 0)


def column_roles(
    df: DataFrame, order: Sequence[Column | str] | None = None, compat: bool = False
) -> DataFrame:
    """A2: numeric, date or categorical per column; columns without values are left out.

    Shares are taken over the non-blank cells. ``compat`` tests only the first 20 rows of
    ``order`` but divides by all values.
    """

    def present(c: str) -> Column:
        return ~is_blank(F.col(c))

    tested = df.orderBy(*order).limit(20) if compat else df
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(present(c)).alias("tested"),
            F.count_if(present(c) & _number(df, c).isNotNull()).alias("numbers"),
            F.count_if(present(c) & _is_date(df, c)).alias("dates"),
        ).alias(c)
        for c in df.columns
    ]
    counts = _one_row_to_table(tested.agg(*stats))
    total = F.col("tested")
    if compat:
        total = df.agg(F.count("*")).scalar()
    role = (
        F.when(F.col("numbers") > total * NUMERIC_SHARE, "numeric")
        .when(F.col("dates") > total * DATE_SHARE, "date")
        .otherwise("categorical")
    )
    return counts.where(F.col("tested") > 0).withColumn("role", role)


def group_averages(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """A3: average of every numeric column by every categorical column; blank groups are 'Unknown'.

    Rows are repeated once per categorical column only; the numeric columns stay wide
    until after the aggregation.
    """
    labels = F.array(
        *[
            F.struct(
                F.lit(c).alias("group_column"),
                F.when(is_blank(F.col(c)), "Unknown")
                .otherwise(F.col(c).cast("string"))
                .alias("group_value"),
            )
            for c in categories
        ]
    )
    tall = df.select(F.explode(labels).alias("g"), *[_number(df, n).alias(n) for n in numbers])
    wide = tall.groupBy("g").agg(*[F.avg(n).alias(n) for n in numbers])
    return (
        wide.select("g.*", *numbers)
        .unpivot(["group_column", "group_value"], list(numbers), "number_column", "average")
        .where(F.col("average").isNotNull())
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A4: count of each non-blank value."""
    kept = df.where(~is_blank(F.col(column)))
    return kept.groupBy(column).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], threshold: int = 5) -> DataFrame:
    """A5: exact distinct values per column and whether there are more than ``threshold``.

    One scan: a row becomes its (column, value) pairs, which are made distinct map-side
    first. A column without any value counts 0.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).distinct()
    counts = values.groupBy("column").agg(F.count("v").alias("n"))
    zeros = df.sparkSession.createDataFrame([(c, 0) for c in columns], "column string, n long")
    counts = counts.unionByName(zeros).groupBy("column").agg(F.max("n").alias("n"))
    return counts.withColumn("many", F.col("n") > threshold)


def distinct_counts_approx(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """A5 as one pass of sketches, for very wide tables where an estimate is enough."""
    stats = [
        F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c, rsd).alias("n")).alias(c)
        for c in columns
    ]
    return _one_row_to_table(df.agg(*stats))


def text_shape(df: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines, and distinct words of the first non-blank line, per text."""
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: strip(x) != "")
    words = F.filter(F.split(F.get("__lines", F.lit(0)), r"\s+"), lambda w: w != "")
    shaped = df.select(key, lines.alias("__lines"))
    return shaped.select(
        key,
        F.size("__lines").cast("long").alias("rows"),
        F.greatest(F.size(F.array_distinct(words)), F.lit(0)).cast("long").alias("columns"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count of a table."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def table_sizes(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in frames.items()
    ]
    merged = counts[0]
    for part in counts[1:]:
        merged = merged.union(part)
    return merged


def field_lengths(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Token counts per field: avg, min, max, count. NULL counts as ''; non-text as JSON."""

    def as_text(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(F.col(c))
        return F.col(c).cast("string")

    stats = []
    for c in fields:
        n = token_count(F.coalesce(as_text(c), F.lit("")))
        stats.append(
            F.struct(
                F.lit(c).alias("field"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"),
                F.max(n).alias("max_tokens"), F.count(n).alias("count"),
            ).alias(c)
        )
    return _one_row_to_table(df.agg(*stats))


def json_field_lengths(df: DataFrame, raw: str) -> DataFrame:
    """A16 for records with dynamic keys: one row per key found in the JSON objects."""
    pairs = df.select(
        F.explode(F.from_json(F.col(raw), "map<string,string>")).alias("field", "value")
    )
    n = token_count(F.coalesce(F.col("value"), F.lit("")))
    return pairs.groupBy("field").agg(
        F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"),
        F.count(n).alias("count"),
    )


def length_summary(df: DataFrame, index: str, length: Column) -> DataFrame:
    """Rounded mean, shortest and longest, each with its first index."""
    return df.select(F.col(index).alias("i"), length.alias("n")).agg(
        F.bround(F.avg("n")).cast("long").alias("average"),
        F.min("n").cast("long").alias("shortest"),
        F.min_by("i", F.struct("n", "i")).alias("shortest_index"),
        F.max("n").cast("long").alias("longest"),
        F.max_by("i", F.struct("n", -F.col("i"))).alias("longest_index"),
    )


def nearest_rank_quantiles(df: DataFrame, column: str, quantiles: Sequence[float]) -> DataFrame:
    """``sorted[int(q * n)]`` for several q.

    Numbers, dates and times are selected by counting in shrinking ranges. Other types are
    put in order: equal values are counted first, and the running count is cut into segments.
    """
    if isinstance(df.select(column).schema[0].dataType, (T.NumericType, T.DateType, T.TimestampType)):
        return values_at_ranks(df, column, quantiles)
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count("*").alias("n")
    )
    placed = global_positions(counts, [F.col("v")], "__pos").withColumn("__all", F.lit(0))
    summed = running(placed, ["__all"], "__pos", {"upto": ("sum", F.col("n"))})
    total = counts.agg(F.sum("n")).scalar()
    ranked = summed.select("v", "upto", total.alias("total"))
    picks = [
        F.struct(
            F.lit(float(q)).alias("q"),
            F.min(F.when(F.col("upto") > F.floor(F.lit(float(q)) * F.col("total")), F.col("v"))).alias(
                "value"
            ),
        )
        for q in quantiles
    ]
    return ranked.agg(F.array(*picks).alias("p")).select(F.inline("p"))


def mean_and_deviation(df: DataFrame, column: str) -> DataFrame:
    """Mean and sample deviation; one value has deviation 0."""
    return df.agg(
        F.avg(column).alias("mean"),
        F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"),
        F.count(column).alias("n"),
    )


def rounded_frequencies(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Frequency of the rounded values."""
    return df.groupBy(F.bround(F.col(column), digits).alias("value")).agg(F.count("*").alias("n"))


def metric_per_file(df: DataFrame, file: str, metric: Column) -> DataFrame:
    """A derived metric summed per file."""
    return df.groupBy(file).agg(F.sum(metric).alias("total"), F.count(metric).alias("rows"))


def chart_bars(df: DataFrame, label: str, value: str) -> DataFrame:
    """Label and numeric value; cells that are no numbers are left out."""
    number = _number(df, value)
    shown = F.coalesce(F.col(label).cast("string"), F.lit("?"))
    return df.where(number.isNotNull()).select(shown.alias("label"), number.alias("value"))


def chart_line(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """Position in the stated order and numeric value."""
    placed = global_positions(df, order, "index")
    number = _number(df, value)
    return placed.where(number.isNotNull()).select("index", number.alias("value"))


# fixed values: words that mark the columns of a timeline
TIMELINE_ROLES: dict[str, list[str]] = {
    "start": ["start"],
    "end": ["end", "finish"],
    "label": ["task", "activity", "event", "name"],
    "group": ["project", "category", "department"],
    "colour": ["owner", "assigned", "person", "user"],
}


def chart_timeline(df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Label, start, end, group and colour columns, found by header words.

    The leftmost header that holds one of a role's words plays it. Without a label column
    the label is the row's place in ``order`` (by default: start, then end), counted from 0.
    """
    found = {}
    for role, words in TIMELINE_ROLES.items():
        # The first header, in order, that contains one of the words.
        fitting = (h for h in df.columns if any(word in h.lower() for word in words))
        found[role] = next(fitting, None)
    if not found["start"] or not found["end"]:
        raise ValueError("no start and end columns for a timeline")
    if not found["label"]:
        found["label"] = "__place"
        df = global_positions(df, [*order] or [F.col(found["start"]), F.col(found["end"])], "__place")
    found["colour"] = found["colour"] or found["label"]
    return df.select(
        *[
            (F.col(h).cast("string") if h else F.lit(None).cast("string")).alias(role)
            for role, h in found.items()
        ]
    )
