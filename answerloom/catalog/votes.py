"""Votes over samples and refinement chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions.common import round6
from answerloom.operators import voting as O
from answerloom.plans import views as V

_S = ("v_samples",)
_COUNTS = """c AS (SELECT item, answer, count(*) AS cnt, min(sample_idx) AS first_idx, max(score) AS best
  FROM v_samples GROUP BY ALL),
w AS (SELECT * FROM c QUALIFY cnt = max(cnt) OVER (PARTITION BY item))"""


@query(
    "a9_majority_vote",
    f"""WITH {_COUNTS} SELECT item, (SELECT CAST(sum(cnt) AS BIGINT) FROM c WHERE c.item = w.item) AS n_samples,
        max(cnt) AS top_count, count(*) AS n_winners,
        CASE WHEN count(*) = 1 THEN min(answer) END AS final_answer FROM w GROUP BY item""",
    _S,
)
def _(t):
    return O.majority_vote(V.v_samples(t)).drop("first_answer")


@query("a9_majority_winners", f"WITH {_COUNTS} SELECT item, answer, cnt, first_idx FROM w", _S)
def _(t):
    return O.majority_winners(V.v_samples(t))


@query(
    "a10_first_of_tie",
    f"WITH {_COUNTS} SELECT item, arg_min(answer, first_idx) AS first_answer FROM w GROUP BY item",
    _S,
)
def _(t):
    return O.majority_vote(V.v_samples(t)).select("item", "first_answer")


@query(
    "a11_score_tie_break",
    f"""WITH {_COUNTS} SELECT item, answer AS final_answer, best AS best_score FROM w
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY best DESC, first_idx) = 1""",
    _S,
)
def _(t):
    return O.score_tie_break(V.v_samples(t))


_STOP = """r AS (SELECT *, count(*) OVER (PARTITION BY item, answer ORDER BY sample_idx) AS seen,
    count(*) OVER (PARTITION BY item) AS n FROM v_samples),
u AS (SELECT * FROM r QUALIFY sample_idx <= coalesce(min(CASE WHEN seen > n / 2 THEN sample_idx END)
    OVER (PARTITION BY item), 1000000)),
uc AS (SELECT item, answer, count(*) AS cnt FROM u GROUP BY ALL),
uw AS (SELECT * FROM uc QUALIFY cnt = max(cnt) OVER (PARTITION BY item))"""


@query(
    "a12_early_stopped_vote",
    f"""WITH {_STOP} SELECT item, (SELECT CAST(sum(cnt) AS BIGINT) FROM uc WHERE uc.item = uw.item) AS n_samples,
        max(cnt) AS top_count, count(*) AS n_winners,
        CASE WHEN count(*) = 1 THEN min(answer) END AS final_answer FROM uw GROUP BY item""",
    _S,
)
def _(t):
    return O.early_stopped_vote(V.v_samples(t)).drop("first_answer")


@query(
    "a13_best_of_n",
    """SELECT item, sample_idx, answer, full_text, score FROM v_samples
       QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, sample_idx) = 1""",
    _S,
)
def _(t):
    return O.best_of_n(V.v_samples(t))


@query(
    "a14_representative",
    f"""WITH {_COUNTS}, f AS (SELECT item, min(answer) AS final_answer FROM w GROUP BY item HAVING count(*) = 1)
        SELECT item, arg_min(full_text, sample_idx) AS full_answer, min(answer) AS final_answer
        FROM v_samples JOIN f USING (item) WHERE answer = final_answer GROUP BY item""",
    _S,
)
def _(t):
    samples = V.v_samples(t)
    return O.representative(samples, O.majority_vote(samples))


@query(
    "a15_answer_groups",
    """SELECT item, answer, sample_idx, count(*) OVER (PARTITION BY item, answer) AS group_size
       FROM v_samples""",
    _S,
)
def _(t):
    return O.answer_groups(V.v_samples(t))


_CHAIN = """SELECT item, sample_idx AS iteration, score, full_text,
  max(score) OVER (PARTITION BY item ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS score_before FROM v_samples"""


@query(
    "w14_accepted_revisions",
    f"""SELECT item, iteration, round(score, 6) + 0.0 AS score, round(score_before, 6) + 0.0 AS score_before,
        score_before IS NULL OR score >= score_before AS accepted FROM ({_CHAIN})""",
    _S,
)
def _(t):
    chain = V.v_samples(t).select("item", F.col("sample_idx").alias("iteration"), "score")
    out = O.accepted_revisions(chain)
    return out.select(
        "item", "iteration", round6(F.col("score")).alias("score"),
        round6(F.col("score_before")).alias("score_before"), "accepted",
    )


@query(
    "l1_refined_answers",
    """SELECT item, count(*) AS n_steps, arg_max(sample_idx, (score, sample_idx)) AS iteration,
         max(score) AS score, arg_max(full_text, (score, sample_idx)) AS full_text
       FROM v_samples GROUP BY item""",
    _S,
)
def _(t):
    chain = V.v_samples(t).select("item", F.col("sample_idx").alias("iteration"), "score", "full_text")
    return O.refine_finals(chain)


@query(
    "t5_argmax",
    """SELECT item, arg_min(letter, letter) AS predicted, max(logp) AS logp FROM (
         SELECT * FROM v_mcq QUALIFY logp = max(logp) OVER (PARTITION BY item)) GROUP BY item""",
    ("v_mcq",),
)
def _(t):
    return O.best_option(V.v_mcq(t))
