"""Row filters, condition lists and previews."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.common import col_of, is_blank, strip
from answerloom.functions.text import parse_numeric

_COMPARE = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
}
_LIST_EXPR_LIMIT = 20


def numeric_condition(column: Column | str, threshold: float, op: str = ">") -> Column:
    """compare the parsed number; unparseable cells and unknown operators match nothing."""
    if op not in _COMPARE:
        return F.lit(False)
    return F.coalesce(_COMPARE[op](parse_numeric(column), F.lit(float(threshold))), F.lit(False))


def contains_any(column: Column | str, needles: Sequence[str]) -> Column:
    """any needle occurs in the trimmed lower-case cell; needles are used as given."""
    cell = F.lower(strip(F.coalesce(col_of(column).cast("string"), F.lit(""))))
    if not needles:
        return F.lit(False)
    if len(needles) <= _LIST_EXPR_LIMIT:
        return reduce(operator.or_, [cell.contains(n) for n in needles])
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: cell.contains(n))


def condition(column: str, value, op: str) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return numeric_condition(column, value, op)
    return contains_any(column, value if isinstance(value, (list, tuple)) else [str(value)])


def fold_conditions(conditions: Sequence[tuple[str, object, str, str]]) -> Column:
    """``(column, value, op, AND|OR)`` folded left to right without precedence.

    The whole list is one predicate, so the table is read once. An empty list keeps all rows.
    """
    if not conditions:
        return F.lit(True)
    column, value, op, _ = conditions[0]
    folded = condition(column, value, op)
    for column, value, op, joiner in conditions[1:]:
        step = condition(column, value, op)
        folded = folded & step if joiner.upper() == "AND" else folded | step
    return folded


def equals_ignoring_case(filters: Mapping[str, object]) -> Column:
    """every named column equals its value, ignoring case."""
    tests = [
        F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) == str(v).lower()
        for c, v in filters.items()
    ]
    return reduce(operator.and_, tests, F.lit(True))


def present_and_above(column: Column | str, threshold: float) -> Column:
    """missing and zero cells drop out before the comparison."""
    value = col_of(column)
    return value.isNotNull() & (value != 0) & (value > threshold)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """remove rows whose cells are all blank."""
    return df.where(~reduce(operator.and_, [is_blank(F.col(c)) for c in df.columns]))


def drop_blank_text(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def project_with_defaults(df: DataFrame, headers: Sequence[str]) -> DataFrame:
    """F8: fixed column order; missing columns and NULL cells become ''."""
    have = set(df.columns)
    return df.select(
        *[
            (F.coalesce(F.col(h).cast("string"), F.lit("")) if h in have else F.lit("")).alias(h)
            for h in headers
        ]
    )


def preview(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First rows in a stated order (a distributed top-n)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 30) -> DataFrame:
    """One page; page numbers below zero read page zero."""
    return df.orderBy(*order).offset(max(number, 0) * size).limit(size)


def length_filter(df: DataFrame, size: Column, max_len: int = 2048) -> DataFrame:
    """keep rows whose sequence is not longer than ``max_len``."""
    return df.where(size <= max_len)


def length_filter_report(df: DataFrame, size: Column, max_len: int = 2048) -> DataFrame:
    """kept and removed counts in one pass."""
    return df.agg(
        F.count("*").alias("original"),
        F.count_if(size <= max_len).alias("filtered"),
        F.count_if(~(size <= max_len)).alias("removed"),
    )


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good, rejected); an undecided check counts as rejected."""
    sure = F.coalesce(valid, F.lit(False))
    return df.where(sure), df.where(~sure)


def rows_per_rule(
    df: DataFrame, rules: Mapping[str, Sequence[tuple[str, object, str, str]]]
) -> DataFrame:
    """Every row once per rule it satisfies, from a single scan."""
    marks = F.array(
        *[F.when(fold_conditions(conds), F.lit(rule)) for rule, conds in rules.items()]
    )
    return df.withColumn("rule_id", F.explode(F.array_compact(marks)))


def structured_or_fallback(
    df: DataFrame, predicate: Column, order: Sequence[Column | str], k: int, fallback: DataFrame
) -> DataFrame:
    """Top rows of the structured filter; the fallback only when it found nothing."""
    found = df.where(predicate).orderBy(*order).limit(k)
    structured = found.withColumn("source", F.lit("structured"))
    semantic = fallback.withColumn("source", F.lit("semantic"))
    hits = found.agg(F.count("*")).scalar()
    return structured.unionByName(semantic.where(hits == 0), allowMissingColumns=True)
