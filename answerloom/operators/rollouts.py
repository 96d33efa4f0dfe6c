"""Rollout statistics: advantages, objectives, divergences, step metrics.

Per-group means and deviations are aggregated and joined back instead of computed in a
window, so a prompt with very many rollouts is not sent to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.plans.skew import with_group_stats

# fixed value: guard against division by zero in the normalised advantage
STD_GUARD = 1e-4


def _normalised(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + STD_GUARD)


def group_advantage(
    df: DataFrame, reward: str = "reward", group: str = "prompt_id", out: str = "advantage"
) -> DataFrame:
    """Reward normalised by its group's mean and sample deviation; NULL for a group of one."""
    r = F.col(reward)
    stats = with_group_stats(df, [group], {"__m": F.avg(r), "__s": F.stddev_samp(r)})
    return stats.withColumn(out, _normalised(r, F.col("__m"), F.col("__s"))).drop("__m", "__s")


def mean_advantage(
    df: DataFrame, reward: str = "reward", group: str = "prompt_id", out: str = "advantage"
) -> DataFrame:
    """Reward minus the group mean."""
    stats = with_group_stats(df, [group], {"__m": F.avg(reward)})
    return stats.withColumn(out, F.col(reward) - F.col("__m")).drop("__m")


def multi_reward_advantage(
    df: DataFrame, rewards: dict[str, float], group: str = "prompt_id", out: str = "advantage"
) -> DataFrame:
    """Normalise each reward in its group, add them by weight, normalise the sum again.

    The sum's mean is zero and its variance follows from the rewards' covariances, so one
    aggregate and one join serve both normalisations. A missing reward counts nowhere: its
    row gets no advantage and is left out of the group's figures.
    """
    names, weights = list(rewards), [float(w) for w in rewards.values()]
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(name).isNotNull()
    used = {name: F.when(whole, F.col(name)) for name in names}
    stats = {}
    for i, a in enumerate(names):
        stats[f"__m{i}"] = F.avg(used[a])
        stats[f"__s{i}"] = F.stddev_samp(used[a])
        for j in range(i):
            stats[f"__c{i}_{j}"] = F.covar_samp(used[a], used[names[j]])
    staged = with_group_stats(df, [group], stats)
    total, variance = F.lit(0.0), F.lit(0.0)
    for i, name in enumerate(names):
        deviation = F.col(f"__s{i}")
        total = total + weights[i] * _normalised(F.col(name), F.col(f"__m{i}"), deviation)
        share = weights[i] / (deviation + STD_GUARD)
        variance = variance + share * share * deviation * deviation
        for j in range(i):
            other = weights[j] / (F.col(f"__s{j}") + STD_GUARD)
            variance = variance + 2 * share * other * F.col(f"__c{i}_{j}")
    spread = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return staged.withColumn(out, _normalised(total, F.lit(0.0), spread)).drop(*stats)


def advantage_stats(df: DataFrame, step: str = "step", advantage: str = "advantage") -> DataFrame:
    """Mean and sample deviation of the advantages per step."""
    return df.groupBy(step).agg(
        F.avg(advantage).alias("adv_avg"), F.stddev_samp(advantage).alias("adv_std")
    )


def drop_zero_signal(df: DataFrame, reward: str = "reward", group: str = "prompt_id") -> DataFrame:
    """drop groups whose rewards are all equal."""
    stats = with_group_stats(df, [group], {"__lo": F.min(reward), "__hi": F.max(reward)})
    return stats.where(F.col("__lo") != F.col("__hi")).drop("__lo", "__hi")


def drop_zero_advantage(
    df: DataFrame, advantage: str = "advantage", group: str = "prompt_id", atol: float = 1e-8
) -> DataFrame:
    """drop groups whose advantages are all within ``atol`` of zero."""
    stats = with_group_stats(df, [group], {"__top": F.max(F.abs(advantage))})
    return stats.where(F.col("__top") > atol).drop("__top")


def policy_gradient_loss(
    df: DataFrame, advantage: str = "advantage", logp: str = "logp_new", group: str = "prompt_id"
) -> DataFrame:
    """Minus the mean of advantage times log-probability."""
    return df.groupBy(group).agg((-F.avg(F.col(advantage) * F.col(logp))).alias("pg_loss"))


def clipped_objective(
    adv: Column,
    ratio: Column,
    low: float = 0.2,
    high: float | None = None,
    mode: str = "signed",
) -> Column:
    """Ratio times advantage against the clipped ratio.

    ``signed`` takes the smaller product for advantages >= 0 and the larger one below
    zero; ``ppo`` always takes the smaller one.
    """
    high = low if high is None else high
    clipped = F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    free, held = ratio * adv, clipped * adv
    if mode == "ppo":
        return F.least(free, held)
    return F.when(adv >= 0, F.least(free, held)).otherwise(F.greatest(free, held))


def clipped_loss(
    df: DataFrame,
    eps: float = 0.2,
    mode: str = "signed",
    group: str = "prompt_id",
    advantage: str = "advantage",
) -> DataFrame:
    """Clipped-ratio loss and mean ratio per group."""
    ratio = F.exp(F.col("logp_new") - F.col("logp_old"))
    objective = clipped_objective(F.col(advantage), ratio, eps, mode=mode)
    return df.groupBy(group).agg(
        (-F.avg(objective)).alias("pg_loss"), F.avg(ratio).alias("policy_ratio")
    )


def token_level_loss(
    df: DataFrame,
    group: str,
    low: float = 0.2,
    high: float = 0.28,
    advantage: str = "advantage",
) -> DataFrame:
    """Ratio capped at 1 + high, clipped to [1 - low, 1 + high], averaged over all tokens."""
    ratio = F.least(F.exp(F.col("logp_new") - F.col("logp_old")), F.lit(1 + high))
    objective = clipped_objective(F.col(advantage), ratio, low, high)
    return df.groupBy(group).agg(
        (-F.avg(objective)).alias("pg_loss"), F.avg(ratio).alias("policy_ratio")
    )


def divergence_terms(df: DataFrame, coeff: float, group: str = "prompt_id") -> DataFrame:
    """Plain and reweighted divergence from the reference policy."""
    gap = F.col("logp_new") - F.col("logp_ref")
    weight = F.exp(F.col("logp_new") - F.col("logp_old"))
    return df.groupBy(group).agg(
        (coeff * F.avg(gap)).alias("kl_loss"), (coeff * F.avg(weight * gap)).alias("kl_reweighted")
    )


def off_policy_mask(df: DataFrame, delta: float, advantage: str = "advantage") -> DataFrame:
    """Zero a negative advantage whose per-token drift from the old policy exceeds ``delta``."""
    drift = F.try_divide(F.col("logp_old") - F.col("logp_new"), F.col("gen_len").cast("double"))
    stale = (F.col(advantage) < 0) & (drift > delta)
    return df.withColumn(advantage, F.when(stale, 0.0).otherwise(F.col(advantage)))


def step_metrics(df: DataFrame, step: str = "step", advantage: str = "advantage") -> DataFrame:
    """The logged metrics of every step in one aggregation."""
    return df.groupBy(step).agg(
        F.avg("reward").alias("reward_avg"),
        F.avg("format_reward").alias("format_reward_avg"),
        F.avg(advantage).alias("adv_avg"),
        F.stddev_samp(advantage).alias("adv_std"),
        F.avg(F.exp(F.col("logp_new") - F.col("logp_old"))).alias("policy_ratio"),
        F.avg("gen_len").alias("avg_response_len"),
        F.sum("gen_len").alias("tokens"),
        F.avg((F.col("reward") > 0).cast("double")).alias("acc"),
    )


def throughput(metrics: DataFrame, seconds: Column) -> DataFrame:
    """Tokens per second of a step, NULL when no time passed."""
    return metrics.withColumn("tokens_per_sec", F.try_divide(F.col("tokens"), seconds))


def sample_log(
    df: DataFrame, step: str = "step", order: tuple[str, ...] = ("prompt_id", "rollout_id"),
    every: int = 10, keep: int = 3,
) -> DataFrame:
    """The first samples of every tenth step, newlines written as ``\\n``.

    The per-step limit is applied before the shuffle too (a group limit), so at most
    ``keep`` rows per step and task move.
    """
    rank = F.row_number().over(W.partitionBy(step).orderBy(*order))
    picked = df.where(F.col(step) % every == 0).withColumn("__rn", rank).where(F.col("__rn") <= keep)
    escaped = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return picked.withColumn("text", escaped).drop("__rn")


# --- token rows (seq_id, pos, token_id, logp, p, prompt_len) ---------------------------


def sequence_logprob(tokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Log-probability and probability of the generated part; 0 and 1 when it is empty."""
    answer = F.col("pos") >= F.col("prompt_len") - 1
    total = F.coalesce(F.sum(F.when(answer, F.col("logp"))), F.lit(0.0))
    return tokens.groupBy(seq).agg(total.alias("logprob")).withColumn("prob", F.exp("logprob"))


def mean_answer_logprob(tokens: DataFrame, seq: str = "seq_id", empty: float = -1e9) -> DataFrame:
    """Average log-probability of the answer tokens, ``empty`` when there are none."""
    answer = F.col("pos") >= F.col("prompt_len") - 1
    mean = F.coalesce(F.avg(F.when(answer, F.col("logp"))), F.lit(float(empty)))
    return tokens.groupBy(seq).agg(mean.alias("avg_logprob"))


def option_logprob(
    tokens: DataFrame, item: str, option: str, empty: float = float("-inf")
) -> DataFrame:
    """G2 teacher-forced: mean log-probability of each option's own tokens.

    An option without tokens behind the prompt gets ``empty``, so it never wins.
    """
    answer = F.col("pos") >= F.col("prompt_len")
    mean = F.coalesce(F.avg(F.when(answer, F.col("logp"))), F.lit(float(empty)))
    return tokens.groupBy(item, option).agg(mean.alias("avg_logprob"))


def mean_step_entropy(tokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Entropy of each answer position, then the mean over positions; 0 when empty."""
    p = F.col("p")
    plogp = F.when(p > 0, p * F.log(p)).otherwise(0.0)
    answer = F.col("pos") >= F.col("prompt_len") - 1
    steps = tokens.groupBy(seq, "pos").agg(
        (-F.sum(plogp)).alias("__h"), F.max(answer).alias("__answer")
    )
    mean = F.coalesce(F.avg(F.when(F.col("__answer"), F.col("__h"))), F.lit(0.0))
    return steps.groupBy(seq).agg(mean.alias("entropy"))


def batch_mean_of_example_means(
    df: DataFrame, batch: str, example: str, value: Column
) -> DataFrame:
    """Mean per example over at least one token, then the mean over the batch's examples."""
    per = df.groupBy(batch, example).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("__s"), F.count(value).alias("__n")
    )
    mean = F.col("__s") / F.greatest(F.col("__n"), F.lit(1))
    return per.groupBy(batch).agg(
        F.avg(mean).alias("batch_mean"), F.count("*").alias("examples"), F.sum("__n").alias("tokens")
    )
