"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``views`` are prepended to ``sql``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = None
        if sql is not None:
            from answerloom.plans.views import with_views

            text = with_views(views, sql)
        REGISTRY[name] = Entry(lambda spark, folder: fn(Tables(spark, folder)), text)
        return fn

    return register


_BLOCK = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(
  range(1, least(length(a) - i + 1, length(b)) + 1), lambda k:
  CASE WHEN contains(b, substr(a, i, k)) THEN [k, -i] ELSE [0, 0] END))))"""


def matching_sql(pairs: str) -> str:
    """WITH RECURSIVE parts giving ``ratio(a0, b0, score)`` for the texts in ``pairs(a0, b0)``.

    Pieces are cut at their longest common block (first in ``a``, then in ``b``) until none is
    left; the score is twice the characters in blocks over the length of both texts.
    """
    return f"""WITH RECURSIVE pairs AS ({pairs}),
      piece AS (SELECT a0, b0, a0 AS a, b0 AS b FROM pairs
        UNION ALL SELECT a0, b0, c.a, c.b FROM (SELECT a0, b0, unnest([
            {{'a': substr(a, 1, -m[2] - 1), 'b': substr(b, 1, j - 1)}},
            {{'a': substr(a, m[1] - m[2]), 'b': substr(b, j + m[1])}}]) AS c
          FROM (SELECT *, strpos(b, substr(a, -m[2], m[1])) AS j FROM (
            SELECT *, {_BLOCK} AS m FROM piece WHERE a <> '' AND b <> '') WHERE m[1] > 0))),
      ratio AS (SELECT a0, b0, CASE WHEN any_value(a0) = any_value(b0) THEN 1.0::DOUBLE ELSE
          2.0::DOUBLE * sum(CASE WHEN a <> '' AND b <> '' THEN ({_BLOCK})[1] ELSE 0 END)
            / (length(any_value(a0)) + length(any_value(b0))) END AS score
        FROM piece GROUP BY a0, b0)"""
