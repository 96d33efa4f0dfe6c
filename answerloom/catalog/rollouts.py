"""Advantages, objectives, token statistics and step metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions.common import round6
from answerloom.operators import rollouts as O
from answerloom.plans import views as V

_R = ("v_rollouts",)
_T = ("v_tokens",)
_W = "OVER (PARTITION BY prompt_id)"
_ADV = f"(reward - avg(reward) {_W}) / (stddev_samp(reward) {_W} + 1e-4)"
_ADV_ROWS = f"a AS (SELECT *, {_ADV} AS adv, exp(logp_new - logp_old) AS ratio FROM v_rollouts)"


def _r(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def _rounded(df, *names):
    return df.withColumns({n: round6(F.col(n)) for n in names})


@query(
    "w5_group_advantage",
    f"SELECT prompt_id, rollout_id, {_r(_ADV)} AS advantage FROM v_rollouts",
    _R,
)
def _(t):
    out = O.group_advantage(V.v_rollouts(t).select("prompt_id", "rollout_id", "reward"))
    return _rounded(out, "advantage").drop("reward")


@query(
    "w6_mean_advantage",
    f"SELECT prompt_id, rollout_id, {_r(f'reward - avg(reward) {_W}')} AS advantage FROM v_rollouts",
    _R,
)
def _(t):
    out = O.mean_advantage(V.v_rollouts(t).select("prompt_id", "rollout_id", "reward"))
    return _rounded(out, "advantage").drop("reward")


@query(
    "w7_multi_reward_advantage",
    f"""WITH s AS (SELECT prompt_id, rollout_id, {_ADV}
          + 0.5 * (format_reward - avg(format_reward) {_W}) / (stddev_samp(format_reward) {_W} + 1e-4) AS x
        FROM v_rollouts)
        SELECT prompt_id, rollout_id, {_r(f'(x - avg(x) {_W}) / (stddev_samp(x) {_W} + 1e-4)')} AS advantage
        FROM s""",
    _R,
)
def _(t):
    rows = V.v_rollouts(t).select("prompt_id", "rollout_id", "reward", "format_reward")
    out = O.multi_reward_advantage(rows, {"reward": 1.0, "format_reward": 0.5})
    return _rounded(out, "advantage").drop("reward", "format_reward")


@query(
    "w8_advantage_stats",
    f"""WITH {_ADV_ROWS} SELECT step, {_r('avg(adv)')} AS adv_avg, {_r('stddev_samp(adv)')} AS adv_std
        FROM a GROUP BY step""",
    _R,
)
def _(t):
    return _rounded(O.advantage_stats(O.group_advantage(V.v_rollouts(t))), "adv_avg", "adv_std")


@query(
    "f13_zero_signal",
    f"""SELECT prompt_id, rollout_id, reward FROM v_rollouts
        QUALIFY min(reward) {_W} <> max(reward) {_W}""",
    _R,
)
def _(t):
    return O.drop_zero_signal(V.v_rollouts(t).select("prompt_id", "rollout_id", "reward"))


@query(
    "f13_zero_advantage",
    f"""WITH {_ADV_ROWS} SELECT prompt_id, rollout_id FROM a QUALIFY max(abs(adv)) {_W} > 1e-8""",
    _R,
)
def _(t):
    rows = V.v_rollouts(t).select("prompt_id", "rollout_id", "reward")
    return O.drop_zero_advantage(O.group_advantage(rows)).select("prompt_id", "rollout_id")


@query(
    "w15_sample_log",
    """SELECT step, prompt_id, rollout_id, replace(text, chr(10), '\\n') AS text FROM v_rollouts
       WHERE step % 10 = 0
       QUALIFY row_number() OVER (PARTITION BY step ORDER BY prompt_id, rollout_id) <= 3""",
    _R,
)
def _(t):
    return O.sample_log(V.v_rollouts(t).select("step", "prompt_id", "rollout_id", "text"))


@query(
    "g6_policy_gradient_loss",
    f"WITH {_ADV_ROWS} SELECT prompt_id, {_r('-avg(adv * logp_new)')} AS pg_loss FROM a GROUP BY prompt_id",
    _R,
)
def _(t):
    return _rounded(O.policy_gradient_loss(O.group_advantage(V.v_rollouts(t))), "pg_loss")


_CLIP = "greatest(0.8, least(1.2, ratio))"


@query(
    "g7_clipped_loss",
    f"""WITH {_ADV_ROWS} SELECT prompt_id, {_r(f'''-avg(CASE WHEN adv >= 0
          THEN least(ratio * adv, {_CLIP} * adv) WHEN adv < 0 THEN greatest(ratio * adv, {_CLIP} * adv) END)''')}
          AS pg_loss, {_r('avg(ratio)')} AS policy_ratio FROM a GROUP BY prompt_id""",
    _R,
)
def _(t):
    out = O.clipped_loss(O.group_advantage(V.v_rollouts(t)))
    return _rounded(out, "pg_loss", "policy_ratio")


@query(
    "g7_clipped_loss_ppo",
    f"""WITH {_ADV_ROWS} SELECT prompt_id,
          {_r(f'-avg(CASE WHEN adv IS NOT NULL THEN least(ratio * adv, {_CLIP} * adv) END)')} AS pg_loss,
          {_r('avg(ratio)')} AS policy_ratio FROM a GROUP BY prompt_id""",
    _R,
)
def _(t):
    out = O.clipped_loss(O.group_advantage(V.v_rollouts(t)), mode="ppo")
    return _rounded(out, "pg_loss", "policy_ratio")


@query(
    "g8_token_level_loss",
    f"""WITH r AS (SELECT seq_id, logit - avg(logit) OVER (PARTITION BY seq_id) AS adv,
          least(exp(logp - ln(0.25)), 1.28) AS ratio FROM v_tokens)
        SELECT seq_id, {_r('''-avg(CASE WHEN adv >= 0 THEN least(ratio * adv, greatest(0.8, least(1.28, ratio)) * adv)
          ELSE greatest(ratio * adv, greatest(0.8, least(1.28, ratio)) * adv) END)''')} AS pg_loss,
          {_r('avg(ratio)')} AS policy_ratio FROM r GROUP BY seq_id""",
    _T,
)
def _(t):
    rows = O.mean_advantage(V.v_tokens(t), "logit", "seq_id")
    rows = rows.withColumns({"logp_new": F.col("logp"), "logp_old": F.log(F.lit(0.25))})
    return _rounded(O.token_level_loss(rows, "seq_id"), "pg_loss", "policy_ratio")


@query(
    "g9_divergence_terms",
    f"""SELECT prompt_id, {_r('0.02 * avg(logp_new - logp_ref)')} AS kl_loss,
          {_r('0.02 * avg(exp(logp_new - logp_old) * (logp_new - logp_ref))')} AS kl_reweighted
        FROM v_rollouts GROUP BY prompt_id""",
    _R,
)
def _(t):
    return _rounded(O.divergence_terms(V.v_rollouts(t), 0.02), "kl_loss", "kl_reweighted")


@query(
    "g10_off_policy_mask",
    f"""WITH {_ADV_ROWS} SELECT prompt_id, rollout_id, {_r('''CASE WHEN adv < 0 AND
          (logp_old - logp_new) / gen_len > 0.01 THEN 0.0 ELSE adv END''')} AS advantage FROM a""",
    _R,
)
def _(t):
    rows = V.v_rollouts(t).drop("text", "step", "format_reward", "logp_ref")
    out = O.off_policy_mask(O.group_advantage(rows), 0.01)
    return _rounded(out, "advantage").select("prompt_id", "rollout_id", "advantage")


@query(
    "g11_step_metrics",
    f"""WITH {_ADV_ROWS} SELECT step, {_r('avg(reward)')} AS reward_avg,
          {_r('avg(format_reward)')} AS format_reward_avg, {_r('avg(adv)')} AS adv_avg,
          {_r('stddev_samp(adv)')} AS adv_std, {_r('avg(ratio)')} AS policy_ratio,
          {_r('avg(gen_len)')} AS avg_response_len, CAST(sum(gen_len) AS BIGINT) AS tokens,
          {_r('avg(CASE WHEN reward > 0 THEN 1.0 ELSE 0.0 END)')} AS acc,
          {_r('sum(gen_len) / (step + 1.0)')} AS tokens_per_sec FROM a GROUP BY step""",
    _R,
)
def _(t):
    metrics = O.step_metrics(O.group_advantage(V.v_rollouts(t)))
    out = O.throughput(metrics, F.col("step") + 1.0)
    return _rounded(
        out, "reward_avg", "format_reward_avg", "adv_avg", "adv_std", "policy_ratio",
        "avg_response_len", "acc", "tokens_per_sec",
    )


@query(
    "g1_sequence_logprob",
    f"""SELECT seq_id, {_r('coalesce(sum(logp) FILTER (WHERE pos >= prompt_len - 1), 0.0)')} AS logprob
        FROM v_tokens GROUP BY seq_id""",
    _T,
)
def _(t):
    return _rounded(O.sequence_logprob(V.v_tokens(t)).drop("prob"), "logprob")


@query(
    "g2_mean_answer_logprob",
    f"""SELECT seq_id, {_r('coalesce(avg(logp) FILTER (WHERE pos >= prompt_len - 1), -1e9)')} AS avg_logprob
        FROM v_tokens GROUP BY seq_id""",
    _T,
)
def _(t):
    return _rounded(O.mean_answer_logprob(V.v_tokens(t)), "avg_logprob")


@query(
    "g2_option_logprob",
    f"""SELECT seq_id // 4 AS item, seq_id % 4 AS option, {_r("coalesce(avg(logp) FILTER (WHERE "
          "pos >= 24 + seq_id % 7), '-inf'::DOUBLE)")} AS avg_logprob
        FROM v_tokens GROUP BY ALL""",
    _T,
)
def _(t):
    rows = V.v_tokens(t).withColumns(
        {
            "item": F.floor(F.col("seq_id") / 4).cast("long"),
            "option": F.col("seq_id") % 4,
            "prompt_len": 24 + F.col("seq_id") % 7,
        }
    )
    return _rounded(O.option_logprob(rows, "item", "option"), "avg_logprob")


@query(
    "g3_mean_step_entropy",
    f"""SELECT seq_id, {_r('coalesce(avg(h) FILTER (WHERE pos >= 4), 0.0)')} AS entropy FROM (
          SELECT seq_id, pos, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END) AS h
          FROM v_tokens GROUP BY seq_id, pos) GROUP BY seq_id""",
    _T,
)
def _(t):
    return _rounded(O.mean_step_entropy(V.v_tokens(t)), "entropy")


@query(
    "g4_joint_probability",
    f"""SELECT item, {_r('sum(logp)')} AS logprob, {_r('exp(sum(logp))')} AS prob
        FROM v_mcq GROUP BY item""",
    ("v_mcq",),
)
def _(t):
    rows = V.v_mcq(t).withColumns({"pos": F.lit(1), "prompt_len": F.lit(1)})
    return _rounded(O.sequence_logprob(rows, "item"), "logprob", "prob")


@query(
    "a23_batch_mean",
    f"""SELECT pos, {_r('avg(m)')} AS batch_mean, count(*) AS examples, CAST(sum(n) AS BIGINT) AS tokens
        FROM (SELECT pos, seq_id, sum(-logp) / greatest(count(logp), 1) AS m, count(logp) AS n
          FROM v_tokens GROUP BY pos, seq_id) GROUP BY pos""",
    _T,
)
def _(t):
    out = O.batch_mean_of_example_means(V.v_tokens(t), "pos", "seq_id", -F.col("logp"))
    return _rounded(out, "batch_mean")
