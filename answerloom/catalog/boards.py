"""Leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions.common import round6
from answerloom.operators import boards as O
from answerloom.plans import views as V

_V = ("v_votes",)


@query(
    "a21_pair_wins",
    "SELECT arena, winner, loser, count(*) AS wins FROM v_votes GROUP BY ALL",
    _V,
)
def _(t):
    return O.pair_wins(V.v_votes(t))


@query(
    "t2_leaderboard",
    """WITH g AS (SELECT arena, winner AS model, 1 AS won FROM v_votes
         UNION ALL SELECT arena, loser, 0 FROM v_votes),
       r AS (SELECT arena, model, avg(won) AS rating, count(*) AS votes FROM g GROUP BY ALL)
       SELECT arena, model, round(rating, 6) + 0.0 AS rating, votes, CAST(row_number() OVER (PARTITION BY arena
         ORDER BY rating DESC, model) AS INTEGER) AS rank FROM r""",
    _V,
)
def _(t):
    out = O.leaderboard(O.win_rates(V.v_votes(t)))
    return out.withColumn("rating", round6(F.col("rating")))


# An ordered fold: every step takes the next vote of each arena and carries all ratings.
_ELO = """RECURSIVE names AS MATERIALIZED (SELECT arena, list(DISTINCT m ORDER BY m) AS models FROM (
    SELECT arena, winner AS m FROM v_votes UNION ALL SELECT arena, loser FROM v_votes) GROUP BY arena),
  steps AS MATERIALIZED (SELECT arena, row_number() OVER (PARTITION BY arena ORDER BY seq) AS i,
    list_position(models, winner) AS w, list_position(models, loser) AS l FROM v_votes JOIN names USING (arena)),
  fold AS (SELECT arena, CAST(0 AS BIGINT) AS i, list_transform(models, lambda m: 1000.0::DOUBLE) AS r FROM names
    UNION ALL
    SELECT arena, i, list_transform(r, lambda x, k: CASE WHEN k = w THEN x + gain WHEN k = l THEN x - gain ELSE x END)
    FROM (SELECT fold.arena, steps.i, fold.r, w, l,
            32.0 / (1.0 + 10.0 ** ((r[w] - r[l]) / 400.0)) AS gain
          FROM fold JOIN steps ON steps.arena = fold.arena AND steps.i = fold.i + 1)),
  ended AS (SELECT arena, unnest(models) AS model, unnest(r) AS rating FROM (
    SELECT * FROM fold QUALIFY i = max(i) OVER (PARTITION BY arena)) JOIN names USING (arena))"""
_RANKED = """CAST(row_number() OVER (PARTITION BY arena ORDER BY rating DESC, model) AS INTEGER) AS rank"""
ELO_SQL = f"WITH {_ELO} SELECT arena, model, round(rating, 6) + 0.0 AS rating FROM ended"

# 500 steps of the published fit on the pair counts; the last model stays at zero.
_BRADLEY_TERRY = """RECURSIVE names AS MATERIALIZED (SELECT arena, list(DISTINCT m ORDER BY m) AS models FROM (
    SELECT arena, winner AS m FROM v_votes UNION ALL SELECT arena, loser FROM v_votes) GROUP BY arena),
  pairs AS MATERIALIZED (SELECT arena, any_value(models) AS models, list({'w': list_position(models, winner),
      'l': list_position(models, loser), 'n': n / total} ORDER BY winner, loser) AS p
    FROM (SELECT *, sum(n) OVER (PARTITION BY arena) AS total FROM (
            SELECT arena, winner, loser, count(*)::DOUBLE AS n FROM v_votes GROUP BY arena, winner, loser))
    JOIN names USING (arena) GROUP BY arena),
  fit AS (SELECT arena, 0 AS t, list_transform(models, lambda x: 0.0::DOUBLE) AS theta,
      list_transform(models, lambda x: 0.0::DOUBLE) AS m, list_transform(models, lambda x: 0.0::DOUBLE) AS v FROM names
    UNION ALL
    SELECT arena, t, list_transform(theta, lambda x, k: CASE WHEN k = len(theta) THEN 0.0 ELSE
        x - 0.01 * (m[k] / (1 - 0.9 ** t)) / (sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8) END), m, v
    FROM (SELECT arena, t, theta, list_transform(m, lambda x, k: 0.9 * x + 0.1 * g[k]) AS m,
            list_transform(v, lambda x, k: 0.999 * x + 0.001 * g[k] * g[k]) AS v
          FROM (SELECT fit.arena, t + 1 AS t, theta, m, v, list_transform(theta, lambda x, k: 1e-4 * x
                    + list_sum(list_transform(p, lambda e: CASE WHEN e.l = k THEN 1.0 WHEN e.w = k THEN -1.0
                        ELSE 0.0 END * e.n / (1.0 + exp(theta[e.w] - theta[e.l]))))) AS g
                FROM fit JOIN pairs USING (arena) WHERE t < 500))),
  ended AS (SELECT arena, unnest(models) AS model, unnest(list_transform(theta, lambda x: (x - list_avg(theta))
      * 400.0 / ln(10.0) + 1000.0)) AS rating FROM fit JOIN names USING (arena) WHERE t = 500)"""


@query("g12_elo", f"WITH {_ELO} SELECT arena, model, round(rating, 6) + 0.0 AS rating, {_RANKED} FROM ended", _V)
def _(t):
    out = O.leaderboard(O.elo(V.v_votes(t)))
    return out.withColumn("rating", round6(F.col("rating")))


@query("udaf1_ordered_fold", ELO_SQL, _V)
def _(t):
    return O.elo(V.v_votes(t)).withColumn("rating", round6(F.col("rating")))


@query(
    "g13_bradley_terry",
    f"WITH {_BRADLEY_TERRY} SELECT arena, model, round(rating, 3) + 0.0 AS rating, {_RANKED} FROM ended",
    _V,
)
def _(t):
    out = O.leaderboard(O.bradley_terry(V.v_votes(t)))
    return out.withColumn("rating", F.round("rating", 3))
