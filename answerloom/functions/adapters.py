"""Hooks for user code: batch model calls, scorers, embedders."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DELAY = 60.0


def backoff(attempt: int, delay: float) -> float:
    """Seconds to wait after a failed attempt: doubling from ``delay``, at most a minute."""
    return min(delay * 2 ** (attempt - 1), MAX_DELAY)


def with_retries(call: Callable, retries: int, delay: float, sleep=time.sleep):
    """Run ``call`` up to ``retries`` times; the last error is raised."""
    for attempt in range(1, retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            sleep(backoff(attempt, delay))


def generate(
    df: DataFrame,
    prompt: str,
    client: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    out: str = "generated_text",
    concurrency: int | None = None,
    batch_size: int = 32,
    retries: int = 3,
    delay: float = 1.0,
) -> DataFrame:
    """UDF2: send a prompt column to a user-supplied batch model.

    ``client`` builds the caller once per partition; ``concurrency`` bounds the number of
    partitions and so of clients. Pair it with ``remaining`` to resume a run.
    """
    rows = df.repartition(concurrency) if concurrency else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in batches:
            texts: list[str] = []
            prompts = pdf[prompt].tolist()
            for at in range(0, len(prompts), batch_size):
                part = prompts[at : at + batch_size]
                texts.extend(with_retries(lambda p=part: call(p), retries, delay))
            yield pdf.assign(**{out: texts})

    return rows.mapInPandas(run, schema)


def scorer(score: Callable[[pd.Series, pd.Series], pd.Series]):
    """UDF3: ``(answer, prompt) -> double`` over whole column batches."""

    @F.pandas_udf("double")
    def apply(answer: pd.Series, prompt: pd.Series) -> pd.Series:
        return score(answer, prompt).astype("float64")

    return apply


def embedder(build: Callable[[], Callable[[list[str]], Sequence]], batch_size: int = 200):
    """UDF4: ``texts -> vectors``; the model is built once per task and fed in batches."""

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = build()
        for texts in batches:
            values = texts.tolist()
            vectors: list = []
            for at in range(0, len(values), batch_size):
                vectors.extend(encode(values[at : at + batch_size]))
            yield pd.Series([list(map(float, v)) for v in vectors])

    return apply


def all_of(predicates: Sequence[Column]) -> Column:
    """UDF1: a list of row predicates, all of which must hold."""
    keep = F.lit(True)
    for predicate in predicates:
        keep = keep & F.coalesce(predicate, F.lit(False))
    return keep
