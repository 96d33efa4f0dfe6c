"""Votes over samples: majority, tie breaks, early stop, best-of-N, refinement chains.

Input rows are ``(item, sample_idx, answer, ...)``. Every step aggregates map-side and
keeps one small state per group, so an item that owns a large part of the rows is spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.plans.skew import null_safe_join, SEGMENT_ROWS, running, with_group_stats


def answer_counts(samples: DataFrame, item: str = "item", answer: str = "answer") -> DataFrame:
    """Count and first appearance of every answer of an item."""
    return samples.groupBy(item, answer).agg(
        F.count("*").alias("cnt"), F.min("sample_idx").alias("first_idx")
    )


def _top_counts(counts: DataFrame, item: str, answer: str) -> DataFrame:
    """One row per item: samples, top count, and how many answers reach it, with the first one.

    Answers are folded by their count, so a tie of very many answers never becomes a list.
    """
    by_count = counts.groupBy(item, "cnt").agg(
        F.count("*").alias("winners"), F.min_by(answer, "first_idx").alias("first")
    )
    return by_count.groupBy(item).agg(
        F.sum(F.col("cnt") * F.col("winners")).alias("n_samples"),
        F.max("cnt").alias("top_count"),
        F.max_by(F.struct("winners", "first"), "cnt").alias("w"),
    )


def majority_vote(samples: DataFrame, item: str = "item", answer: str = "answer") -> DataFrame:
    """One row per item.

    ``final_answer`` is the unique winner, NULL on a tie; ``first_answer`` breaks a tie by
    first appearance.
    """
    top = _top_counts(answer_counts(samples, item, answer), item, answer)
    return top.select(
        item,
        "n_samples",
        "top_count",
        F.col("w.winners").alias("n_winners"),
        F.when(F.col("w.winners") == 1, F.col("w.first")).alias("final_answer"),
        F.col("w.first").alias("first_answer"),
    )


def majority_winners(samples: DataFrame, item: str = "item", answer: str = "answer") -> DataFrame:
    """Every answer that reaches the top count, one row each, with its first index."""
    counts = answer_counts(samples, item, answer)
    ranked = with_group_stats(counts, [item], {"top_count": F.max("cnt")})
    return ranked.where(F.col("cnt") == F.col("top_count")).drop("top_count")


def score_tie_break(
    samples: DataFrame, item: str = "item", answer: str = "answer", score: str = "score"
) -> DataFrame:
    """Among the winners the one with the best sample score; equal scores go to the earliest."""
    counts = samples.groupBy(item, answer).agg(
        F.count("*").alias("cnt"),
        F.min("sample_idx").alias("first_idx"),
        F.max(score).alias("best_score"),
    )
    rank = F.struct("cnt", "best_score", -F.col("first_idx"))
    return counts.groupBy(item).agg(
        F.max_by(answer, rank).alias("final_answer"), F.max_by("best_score", rank).alias("best_score")
    )


def _votes_with_stops(samples: DataFrame, item: str, answer: str, segment_rows: int) -> DataFrame:
    """``_top_counts`` of all samples with the place where an item's majority is settled.

    Only one answer can hold more than half of the samples. Its (n/2 + 1)-th index is looked
    for alone: counts by segment of the sample index name the segment that holds it, and only
    that segment's indexes are added up, at most ``segment_rows`` an item. ``stop``, ``used``
    and ``settled`` (samples and majority answers up to there) are NULL without a majority.
    """
    segment = F.floor(F.col("sample_idx") / segment_rows)
    pieces = samples.groupBy(item, answer, segment.alias("__seg")).agg(
        F.count("*").alias("cnt"), F.min("sample_idx").alias("first_idx")
    )
    counts = pieces.groupBy(item, answer).agg(
        F.sum("cnt").alias("cnt"), F.min("first_idx").alias("first_idx")
    )
    top = _top_counts(counts, item, answer)
    majority = top.where(F.col("top_count") * 2 > F.col("n_samples")).select(
        item, F.col("w.first").alias("__best"), (F.floor(F.col("n_samples") / 2) + 1).alias("__need")
    )
    is_best = F.col(answer).eqNullSafe(F.col("__best"))
    by_segment = null_safe_join(pieces, majority, [item], "inner").groupBy(item, "__seg").agg(
        F.sum("cnt").alias("__all"),
        F.sum(F.when(is_best, F.col("cnt")).otherwise(0)).alias("__own"),
        F.min("first_idx").alias("__first"),
        F.first("__need").alias("__need"),
        F.first("__best").alias("__best"),
    )
    earlier = W.partitionBy(item).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    for name in ("__all", "__own"):
        by_segment = by_segment.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(earlier), F.lit(0)))
    reached = F.col("__own_before") + F.col("__own") >= F.col("__need")
    holding = by_segment.where(reached & (F.col("__own_before") < F.col("__need"))).drop("__all", "__own")

    near = null_safe_join(samples.select(item, answer, "sample_idx"), holding, [item], "inner")
    end = (F.col("__seg") + 1) * segment_rows
    inside = (F.col("sample_idx") >= F.col("__first")) & (F.col("sample_idx") < end)
    # A segment without indexes holds the samples that have none; they come first.
    inside = F.coalesce(inside, F.col("__seg").isNull() & F.col("sample_idx").isNull())
    places = near.where(inside).groupBy(item, "sample_idx").agg(
        F.count("*").alias("__all"),
        F.count_if(is_best).alias("__own"),
        *[F.first(c).alias(c) for c in ("__all_before", "__own_before", "__need")],
    )
    so_far = W.partitionBy(item).orderBy("sample_idx").rowsBetween(W.unboundedPreceding, 0)
    added = places.select(
        item,
        "sample_idx",
        "__need",
        (F.col("__all_before") + F.sum("__all").over(so_far)).alias("used"),
        (F.col("__own_before") + F.sum("__own").over(so_far)).alias("settled"),
    )
    stops = added.where(F.col("settled") >= F.col("__need")).groupBy(item).agg(
        F.min("sample_idx").alias("stop"), F.min("used").alias("used"), F.min("settled").alias("settled")
    )
    return null_safe_join(top, stops, [item], "left")


def samples_until_majority(
    samples: DataFrame,
    item: str = "item",
    answer: str = "answer",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Samples up to the first moment an answer has more than half of all samples.

    Items that never reach a majority keep all their samples. Samples without an index
    come first.
    """
    votes = _votes_with_stops(samples, item, answer, segment_rows)
    stops = votes.where("used IS NOT NULL").select(item, F.lit(True).alias("__any"), F.col("stop").alias("__stop"))
    kept = null_safe_join(samples, stops, [item], "left")
    used = F.col("__any").isNull() | F.col("sample_idx").isNull() | (F.col("sample_idx") <= F.col("__stop"))
    return kept.where(used).drop("__any", "__stop")


def early_stopped_vote(
    samples: DataFrame, item: str = "item", answer: str = "answer", segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """The vote over the samples that were needed; the majority answer wins where there is one."""
    votes = _votes_with_stops(samples, item, answer, segment_rows)
    return votes.select(
        item,
        F.coalesce("used", "n_samples").alias("n_samples"),
        F.coalesce("settled", "top_count").alias("top_count"),
        F.col("w.winners").alias("n_winners"),
        F.when(F.col("w.winners") == 1, F.col("w.first")).alias("final_answer"),
        F.col("w.first").alias("first_answer"),
    )


def best_option(
    options: DataFrame, item: str = "item", option: str = "letter", score: str = "logp"
) -> DataFrame:
    """T5: the option with the highest score per item; the first option wins ties.

    Missing scores lose to any number; an item without any number takes its first option.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    top = options.groupBy(item).agg(F.max(value).alias("__top"))
    firsts = null_safe_join(options.withColumn("__v", value), top, [item], "inner")
    return (
        firsts.where(F.col("__v") == F.col("__top"))
        .groupBy(item)
        .agg(F.min(option).alias("predicted"), F.first("__top").alias(score))
    )


def best_of_n(samples: DataFrame, item: str = "item", score: str = "score") -> DataFrame:
    """The whole row of the best score per item; the first wins ties."""
    rest = [c for c in samples.columns if c != item]
    rank = F.struct(F.col(score), -F.col("sample_idx"))
    best = samples.groupBy(item).agg(F.max_by(F.struct(*rest), rank).alias("b"))
    return best.select(item, "b.*")


def representative(
    samples: DataFrame, finals: DataFrame, item: str = "item", answer: str = "answer",
    full: str = "full_text",
) -> DataFrame:
    """The first full answer whose short form is the final one."""
    chosen = finals.select(item, F.col("final_answer").alias("__final"))
    matching = samples.join(chosen, item).where(F.col(answer) == F.col("__final"))
    return matching.groupBy(item).agg(
        F.min_by(full, "sample_idx").alias("full_answer"), F.first("__final").alias("final_answer")
    )


def answer_groups(samples: DataFrame, item: str = "item", answer: str = "answer") -> DataFrame:
    """Sample indexes by answer, as rows, with the size of each group."""
    sized = with_group_stats(
        samples.select(item, answer, "sample_idx"), [item, answer], {"group_size": F.count("*")}
    )
    return sized


def accepted_revisions(
    chain: DataFrame,
    item: str = "item",
    iteration: str = "iteration",
    score: str = "score",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Mark revisions whose score is not below the best accepted score so far.

    The accepted score is a running maximum over the earlier iterations, taken segment by
    segment. The first row of a chain is always accepted.
    """
    scanned = running(
        chain,
        [item],
        iteration,
        {"score_before": ("max", F.col(score))},
        exclusive=True,
        segment_rows=segment_rows,
    )
    before = F.col("score_before")
    return scanned.withColumn("accepted", before.isNull() | (F.col(score) >= before))


def refine_finals(
    chain: DataFrame, item: str = "item", iteration: str = "iteration", score: str = "score"
) -> DataFrame:
    """L1: the surviving row of each chain: best score, ties to the later iteration."""
    rest = [c for c in chain.columns if c != item]
    last = F.max_by(F.struct(*rest), F.struct(score, iteration))
    return chain.groupBy(item).agg(last.alias("b"), F.count("*").alias("n_steps")).select(
        item, "n_steps", "b.*"
    )
