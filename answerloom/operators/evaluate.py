"""Graded runs: joins of predictions to truth, accuracy and score summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.grading import final_candidate, grade
from answerloom.functions.text import token_count


def match_predictions(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Inner equi-join that fails when either side has a key the other one lacks.

    The check is a filter, so it holds whichever columns are used afterwards.
    """
    left = truth.withColumn("__t", F.lit(True))
    right = predictions.withColumn("__p", F.lit(True))
    both = left.join(right, key, "full_outer")
    complete = F.col("__t").isNotNull() & F.col("__p").isNotNull()
    message = F.concat(F.lit("unmatched record "), F.col(key).cast("string"))
    checked = F.when(complete, True).otherwise(F.raise_error(message).cast("boolean"))
    return both.where(checked).drop("__t", "__p")


def graded(df: DataFrame, text: str, truth: str, fallback: str = "number_then_full") -> DataFrame:
    """Extract the candidate answer and add its verdict."""
    return grade(df.withColumn("extracted", final_candidate(F.col(text), fallback)), "extracted", truth)


def accuracy(df: DataFrame, subset: str, verdict: str = "verdict", **extra: Column) -> DataFrame:
    """Correct, wrong, undecided and total per subset and overall (subset NULL).

    The rows are aggregated per subset first; the overall line is rolled up from that
    small table. ``extra`` adds summed columns.
    """
    v = F.col(verdict)
    per = df.groupBy(subset).agg(
        F.count_if(v == "correct").alias("correct"),
        F.count_if(v == "wrong").alias("wrong"),
        F.count_if(v == "needs_cas").alias("undecided"),
        F.count("*").alias("total"),
        *[F.sum(c).alias(n) for n, c in extra.items()],
    )
    sums = ["correct", "wrong", "undecided", "total", *extra]
    rolled = per.rollup(subset).agg(*[F.sum(c).alias(c) for c in sums])
    ratio = F.coalesce(F.try_divide("correct", "total"), F.lit(0.0))
    return rolled.withColumn("accuracy", ratio)


def accuracy_with_length(df: DataFrame, subset: str, text: str) -> DataFrame:
    """Accuracy beside the average response length in tokens."""
    out = accuracy(df, subset, n_tokens=token_count(F.col(text)))
    return out.withColumn("avg_tokens", F.col("n_tokens") / F.col("total")).drop("n_tokens")


def evaluation_records(df: DataFrame, index: str, problem: str, truth: str, text: str) -> DataFrame:
    """The record layout of an evaluation log."""
    return df.select(
        F.col(index).alias("index"),
        F.col(problem).alias("problem"),
        F.col(truth).alias("gtruth_answer"),
        F.col(text).alias("generated_text"),
        "extracted",
        (F.col("verdict") == "correct").alias("correct"),
    )


def score_histogram(df: DataFrame, score: str, low: int = 1, high: int = 5) -> DataFrame:
    """One row per score with zero buckets, and the weighted mean on every row."""
    buckets = [
        F.struct(F.lit(k).alias("score"), F.count_if(F.col(score) == k).alias("n"))
        for k in range(low, high + 1)
    ]
    wide = df.agg(F.array(*buckets).alias("b"), F.avg(F.col(score)).alias("mean_score"))
    return wide.select(F.inline("b"), "mean_score")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of every value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / counts.agg(F.sum("n")).scalar())


def gold_pairs(df: DataFrame, problem: str, answer: str, solution: str) -> DataFrame:
    """Rows with a problem, and a reference answer that falls back to the solution."""
    from answerloom.functions.common import is_blank, strip

    reference = F.coalesce(
        F.nullif(strip(F.col(answer)), F.lit("")), strip(F.col(solution)), F.lit("")
    )
    return df.where(~is_blank(F.col(problem))).withColumn("reference", reference)


def running_accuracy(
    df: DataFrame, order: Sequence[Column], correct: Column, every: int = 50
) -> DataFrame:
    """Accuracy so far at every ``every``-th item of a global order.

    Counted per block of ``every`` items, then summed over the blocks: the ordered part
    runs on one row per block.
    """
    from answerloom.plans.skew import global_positions, running

    placed = global_positions(df, order, "__pos")
    blocks = placed.groupBy(F.floor(F.col("__pos") / every).cast("long").alias("block")).agg(
        F.count("*").alias("__n"), F.count_if(correct).alias("__ok")
    )
    summed = running(
        blocks.withColumn("__all", F.lit(0)),
        ["__all"],
        "block",
        {"seen": ("sum", F.col("__n")), "correct": ("sum", F.col("__ok"))},
    )
    full = summed.where(F.col("__n") == every)
    return full.select("seen", "correct", (F.col("correct") / F.col("seen")).alias("accuracy"))
