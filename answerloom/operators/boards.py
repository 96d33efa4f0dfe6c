"""Leaderboards from pairwise votes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.plans.skew import group_positions, largest_group
from answerloom.session import reliable_checkpoint, scratch_path

# fixed values: rating constants
K_FACTOR = 32.0
START_RATING = 1000.0
RATING_SCALE = 400.0
BT_STEPS = 500
BT_RATE = 0.01
BT_DECAY = 1e-4
ADAM = (0.9, 0.999, 1e-8)

SEGMENT_VOTES = 2_000_000
MAX_PAIRS_PER_TASK = 4_000_000


def models(votes: DataFrame) -> DataFrame:
    """U4: distinct models over both vote columns."""
    sides = F.explode(F.array("winner", "loser")).alias("model")
    return votes.select(sides).distinct()


def pair_wins(votes: DataFrame, arena: str = "arena") -> DataFrame:
    """How often each model beat each other model."""
    return votes.groupBy(arena, "winner", "loser").agg(F.count("*").alias("wins"))


def win_rates(votes: DataFrame, arena: str = "arena") -> DataFrame:
    """Share of won votes per model, from the pair counts."""
    pairs = pair_wins(votes, arena)
    sides = F.inline(
        F.array(
            F.struct(F.col("winner").alias("model"), F.col("wins").alias("won")),
            F.struct(F.col("loser").alias("model"), F.lit(0).cast("long").alias("won")),
        )
    )
    played = pairs.select(arena, "wins", sides)
    return played.groupBy(arena, "model").agg(
        (F.sum("won") / F.sum("wins")).alias("rating"), F.sum("wins").alias("votes")
    )


def leaderboard(ratings: DataFrame, group: Sequence[str] = ("arena",)) -> DataFrame:
    """1-based rank by rating, ties by model name. One row per model is ranked."""
    window = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    return ratings.withColumn(
        "rank", F.row_number().over(window.orderBy(F.desc("rating"), F.asc("model")))
    )


def fold_votes(
    ratings: dict[str, float],
    pairs: Iterable[tuple[str, str]],
    k: float = K_FACTOR,
    start: float = START_RATING,
) -> dict[str, float]:
    """Update ratings vote by vote; the points a winner gains are the points the loser gives."""
    for winner, loser in pairs:
        high, low = ratings.get(winner, start), ratings.get(loser, start)
        gain = k / (1.0 + 10.0 ** ((high - low) / RATING_SCALE))
        ratings[winner] = high + gain
        ratings[loser] = low - gain if winner != loser else ratings[winner] - gain
    return ratings


def elo(
    votes: DataFrame,
    arena: str = "arena",
    k: float = K_FACTOR,
    start: float = START_RATING,
    segment_votes: int = SEGMENT_VOTES,
) -> DataFrame:
    """Sequential ratings per arena, folded in ``seq`` order.

    The fold depends on the order, so an arena is folded start to end; arenas run side by
    side. When an arena has more than ``segment_votes`` votes, all arenas advance together
    by segments of that size: a task never holds more than one segment, and only the
    ratings move from one round to the next. Both ways give the same ratings.
    """
    schema = f"{arena} string, model string, rating double"
    slim = votes.select(F.col(arena).cast("string").alias(arena), "seq", "winner", "loser")

    def fold(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
        before = {} if known is None else dict(zip(known["model"], known["rating"]))
        ordered = pdf.sort_values("seq", kind="stable")
        after = fold_votes(before, zip(ordered["winner"], ordered["loser"]), k, start)
        return pd.DataFrame(
            {arena: key[0], "model": list(after), "rating": [float(x) for x in after.values()]}
        )

    if largest_group(slim, [arena]) <= segment_votes:
        return slim.groupBy(arena).applyInPandas(lambda key, pdf: fold(key, pdf), schema)

    spark = votes.sparkSession
    placed = group_positions(slim, [arena], [F.col("seq")], "pos", max_window_rows=segment_votes)
    path = scratch_path(spark, "elo-segments")
    cut = placed.withColumn("segment", F.floor(F.col("pos") / segment_votes).cast("long"))
    cut.drop("pos").write.partitionBy("segment").parquet(path)
    stored = spark.read.parquet(path)
    rounds = stored.agg(F.max("segment")).first()[0] + 1
    ratings = spark.createDataFrame([], schema)
    for segment in range(rounds):
        part = stored.where(F.col("segment") == segment).drop("segment")
        together = part.groupBy(arena).cogroup(ratings.groupBy(arena))
        ratings = reliable_checkpoint(together.applyInPandas(fold, schema))
    return ratings


def fit_bradley_terry(
    winners: np.ndarray, losers: np.ndarray, wins: np.ndarray, n: int, steps: int = BT_STEPS
) -> np.ndarray:
    """Strengths of ``n`` models from pair counts; the last model is pinned to zero.

    The loss is the mean over votes, which the pair counts carry completely.
    """
    theta, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    weight = wins / wins.sum()
    b1, b2, eps = ADAM
    for t in range(1, steps + 1):
        pull = weight / (1.0 + np.exp(theta[winners] - theta[losers]))
        grad = np.bincount(losers, pull, n) - np.bincount(winners, pull, n) + BT_DECAY * theta
        m = b1 * m + (1 - b1) * grad
        v = b2 * v + (1 - b2) * grad * grad
        step = BT_RATE * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + eps)
        step[-1] = 0.0
        theta = theta - step
    return theta


def _to_ratings(theta: np.ndarray) -> np.ndarray:
    scaled = theta * (RATING_SCALE / math.log(10.0))
    return scaled - scaled.mean() + START_RATING


def bradley_terry(
    votes: DataFrame,
    arena: str = "arena",
    max_pairs: int = MAX_PAIRS_PER_TASK,
    steps: int = BT_STEPS,
) -> DataFrame:
    """Maximum-likelihood ratings per arena, centred on 1000.

    Votes are reduced to pair counts first. An arena whose pair counts fit in one task is
    fitted there; otherwise every gradient step is a Spark aggregation over the counts.
    """
    pairs = pair_wins(votes, arena).withColumn(arena, F.col(arena).cast("string"))
    if largest_group(pairs, [arena]) > max_pairs:
        return _bradley_terry_distributed(pairs, arena, steps)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["winner"].to_numpy(str), pdf["loser"].to_numpy(str)]))
        theta = fit_bradley_terry(
            np.searchsorted(names, pdf["winner"].to_numpy(str)),
            np.searchsorted(names, pdf["loser"].to_numpy(str)),
            pdf["wins"].to_numpy(float),
            len(names),
            steps,
        )
        return pd.DataFrame({arena: key[0], "model": names.astype(object), "rating": _to_ratings(theta)})

    return pairs.groupBy(arena).applyInPandas(fit, f"{arena} string, model string, rating double")


def _bradley_terry_distributed(
    pairs: DataFrame, arena: str, steps: int, checkpoint_every: int = 10
) -> DataFrame:
    """The same fit with the model table and the pair counts kept as Spark tables."""
    # A missing arena joins as a value of its own; it is turned back at the end.
    named, null_arena = F.concat(F.lit("="), F.col(arena)), F.lit("")
    pairs = pairs.withColumn(arena, F.coalesce(named, null_arena))
    share = pairs.groupBy(arena).agg(F.sum("wins").alias("__total"))
    edges = reliable_checkpoint(
        pairs.join(share, arena).select(
            arena, "winner", "loser", (F.col("wins") / F.col("__total")).alias("w")
        )
    )
    names = edges.select(arena, F.explode(F.array("winner", "loser")).alias("model")).distinct()
    last = names.groupBy(arena).agg(F.max("model").alias("__last"))
    zero = F.lit(0.0)
    state = names.join(last, arena).select(
        arena, "model", (F.col("model") != F.col("__last")).alias("free"),
        zero.alias("theta"), zero.alias("m"), zero.alias("v"),
    )
    state = reliable_checkpoint(state)
    b1, b2, eps = ADAM
    for t in range(1, steps + 1):
        side = state.select(arena, "model", "theta")
        win = side.select(arena, F.col("model").alias("winner"), F.col("theta").alias("tw"))
        lose = side.select(arena, F.col("model").alias("loser"), F.col("theta").alias("tl"))
        pulled = edges.join(win, [arena, "winner"]).join(lose, [arena, "loser"])
        pull = F.col("w") / (1 + F.exp(F.col("tw") - F.col("tl")))
        ends = F.inline(
            F.array(
                F.struct(F.col("loser").alias("model"), F.col("p").alias("g")),
                F.struct(F.col("winner").alias("model"), (-F.col("p")).alias("g")),
            )
        )
        grads = pulled.select(arena, "winner", "loser", pull.alias("p")).select(arena, ends)
        grads = grads.groupBy(arena, "model").agg(F.sum("g").alias("g"))
        g = F.col("g") + BT_DECAY * F.col("theta")
        moved = state.join(grads, [arena, "model"]).select(
            arena, "model", "free", "theta",
            (b1 * F.col("m") + (1 - b1) * g).alias("m"),
            (b2 * F.col("v") + (1 - b2) * g * g).alias("v"),
        )
        step = BT_RATE * (F.col("m") / (1 - b1**t)) / (F.sqrt(F.col("v") / (1 - b2**t)) + eps)
        state = moved.withColumn("theta", F.when(F.col("free"), F.col("theta") - step).otherwise(0.0))
        if t % checkpoint_every == 0:
            state = reliable_checkpoint(state)
    scaled = state.withColumn("rating", F.col("theta") * (RATING_SCALE / math.log(10.0)))
    centre = scaled.groupBy(arena).agg(F.avg("rating").alias("__mean"))
    back = F.when(F.col(arena) != null_arena, F.substring(arena, 2, 1 << 30)).alias(arena)
    return scaled.join(centre, arena).select(
        back, "model", (F.col("rating") - F.col("__mean") + START_RATING).alias("rating")
    )
