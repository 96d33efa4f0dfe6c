"""Moving averages, trends, distribution cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions.common import round6
from answerloom.operators import sequences as O
from answerloom.plans import views as V

_T = ("v_tokens",)


def _rounded(df, *names):
    return df.withColumns({n: round6(F.col(n)) for n in names})


@query(
    "w1_moving_average_fraction",
    """WITH e AS (SELECT event_type, event_id, CAST(value AS DECIMAL(18,2)) AS v,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos,
         sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY event_id) AS cs,
         greatest(1, CAST(floor(0.25 * count(*) OVER (PARTITION BY event_type)) AS BIGINT)) AS w FROM events)
       SELECT a.event_type, a.event_id, round(CAST(a.cs - coalesce(b.cs, 0) AS DOUBLE)
         / least(a.pos + 1, a.w), 6) + 0.0 AS smoothed
       FROM e a LEFT JOIN e b ON b.event_type = a.event_type AND b.pos = a.pos - a.w""",
)
def _(t):
    rows = t.events.select("event_type", "event_id", "value")
    out = O.moving_average_fraction(rows, ["event_type"], [F.col("event_id")], "value", decimals=2)
    return _rounded(out, "smoothed").select("event_type", "event_id", "smoothed")


@query(
    "w2_moving_average",
    """SELECT event_type, event_id, round(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE)
         / count(*) OVER w, 6) + 0.0 AS smoothed FROM events
       WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    rows = t.events.select("event_type", "event_id", "ts", "value")
    order = [F.col("ts"), F.col("event_id")]
    out = O.moving_average(rows, ["event_type"], order, "value", 10, decimals=2)
    return _rounded(out, "smoothed").select("event_type", "event_id", "smoothed")


@query(
    "w3_trend_by_group",
    """SELECT event_type, 'value' AS metric, n, first_value, last_value,
         CASE WHEN last_value > first_value THEN 'Improving' WHEN last_value < first_value THEN 'Declining'
         ELSE 'Stable' END AS trend FROM (SELECT event_type, count(*) AS n,
           arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value
         FROM events GROUP BY event_type HAVING count(*) >= 2)""",
)
def _(t):
    return O.trend_by_group(t.events, ["event_type"], ["value"], "ts", "event_id")


@query(
    "w4_table_trend",
    """SELECT metric, CAST(f AS DOUBLE) AS first_value, CAST(l AS DOUBLE) AS last_value, first_at, last_at,
         CASE WHEN l > f THEN 'increased' WHEN l < f THEN 'decreased' ELSE 'remained stable' END AS trend
       FROM (SELECT 'o_totalprice' AS metric, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS f,
           arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS l,
           strftime(min(o_orderdate), '%Y-%m-%d') AS first_at, strftime(max(o_orderdate), '%Y-%m-%d') AS last_at
         FROM orders
         UNION ALL SELECT 'o_custkey', arg_min(o_custkey, (o_orderdate, o_orderkey)),
           arg_max(o_custkey, (o_orderdate, o_orderkey)), strftime(min(o_orderdate), '%Y-%m-%d'),
           strftime(max(o_orderdate), '%Y-%m-%d') FROM orders)""",
)
def _(t):
    rows = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return O.table_trend(rows, ["o_totalprice", "o_custkey"], "day", "o_orderkey")


@query(
    "w12_epoch_bounds",
    """SELECT epoch, min(total_steps) AS first_step, max(total_steps) AS last_step,
       (min(total_steps) + max(total_steps)) / 2 AS midpoint FROM v_metrics GROUP BY epoch""",
    ("v_metrics",),
)
def _(t):
    return O.epoch_bounds(V.v_metrics(t), "epoch", "total_steps")


@query(
    "w9_nucleus",
    """WITH r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY seq_id, pos ORDER BY p DESC, token_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_tokens),
       k AS (SELECT * FROM r WHERE before < 0.7)
       SELECT seq_id, pos, token_id, round(p / greatest(sum(p) OVER (PARTITION BY seq_id, pos), 1e-12), 6) + 0.0
         AS share FROM k""",
    _T,
)
def _(t):
    rows = V.v_tokens(t).select("seq_id", "pos", "token_id", "p")
    out = O.nucleus(rows, ["seq_id", "pos"], "token_id", "p", 0.7)
    return _rounded(out, "share").drop("p")


@query(
    "w10_top_k_share",
    """WITH k AS (SELECT * FROM v_tokens QUALIFY row_number() OVER (PARTITION BY seq_id, pos
           ORDER BY p DESC, token_id) <= 2)
       SELECT seq_id, pos, token_id, round(p / sum(p) OVER (PARTITION BY seq_id, pos), 6) + 0.0 AS share FROM k""",
    _T,
)
def _(t):
    rows = V.v_tokens(t).select("seq_id", "pos", "token_id", "p")
    out = O.top_k_share(rows, ["seq_id", "pos"], "token_id", "p", 2)
    return _rounded(out, "share").drop("p")


@query(
    "w11_softmax",
    """WITH e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY seq_id, pos)) / 0.8) AS e FROM v_tokens)
       SELECT seq_id, pos, token_id, round(e / sum(e) OVER (PARTITION BY seq_id, pos), 6) + 0.0 AS share FROM e""",
    _T,
)
def _(t):
    rows = V.v_tokens(t).select("seq_id", "pos", "token_id", "logit")
    return _rounded(O.softmax(rows, ["seq_id", "pos"], "logit", 0.8), "share").drop("logit")
