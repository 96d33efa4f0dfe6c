"""Views derived from the base tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.functions.common import float_divide, float_log
from answerloom.plans.skew import group_positions

# fixed values: the five event types in sorted order
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# fixed values: search terms of the lookup checks
TERMS = ["the", "and", "tion", "le", "der"]
# fixed values: header rows of three files
HEADERS = [
    ("f1", 0, "Dept"), ("f1", 1, "Sales"), ("f1", 2, "Start Date"),
    ("f2", 0, "Department"), ("f2", 1, "Revenue"), ("f2", 2, "Begin"),
    ("f3", 0, "column0"), ("f3", 1, "Équipe"), ("f3", 2, "Amount"),
]


def _numbered_lines(t) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    numbered = group_positions(t.lineitem, ["l_orderkey"], order, "lk")
    return numbered.withColumn("q", F.col("l_quantity").cast("long"))


_LINES_SQL = """
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS lk,
    CAST(l_quantity AS BIGINT) AS q FROM lineitem"""


def v_answers(t) -> DataFrame:
    q = F.col("q").cast("string")
    twice = (F.col("q") * 2).cast("string")
    kind = F.col("lk") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("Work. \\boxed{"), q, F.lit("}")))
        .when(kind == 1, F.concat(F.lit("\\boxed{\\frac{"), twice, F.lit("}{2}}")))
        .when(kind == 2, F.concat(F.lit("The answer is "), q, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("\\boxed{"), (F.col("q") + 1).cast("string"), F.lit("}")))
        .when(kind == 4, F.lit("no result"))
        .otherwise(F.concat(F.lit("\\boxed{"), q, F.lit("} then \\boxed{ {"), q, F.lit("} }")))
    )
    return _numbered_lines(t).select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("lk").cast("string")).alias(
            "index"
        ),
        F.col("l_returnflag").alias("subset"),
        q.alias("gtruth_answer"),
        text.alias("generated_text"),
    )


def v_samples(t) -> DataFrame:
    return _numbered_lines(t).select(
        F.col("l_orderkey").alias("item"),
        F.col("lk").alias("sample_idx"),
        (F.col("l_suppkey") % 3).cast("string").alias("answer"),
        F.concat(F.lit("full "), (F.col("l_suppkey") % 3).cast("string"), F.lit(" #"),
                 F.col("lk").cast("string")).alias("full_text"),
        F.col("l_discount").alias("score"),
    )


def v_rollouts(t) -> DataFrame:
    kind = F.col("lk") % 4
    return _numbered_lines(t).select(
        F.floor(F.col("l_orderkey") / 100).cast("long").alias("step"),
        F.col("l_orderkey").alias("prompt_id"),
        F.col("lk").alias("rollout_id"),
        (F.col("l_returnflag") == "R").cast("double").alias("reward"),
        (F.col("l_linestatus") == "F").cast("double").alias("format_reward"),
        (F.col("l_discount") * -10).alias("logp_new"),
        (F.col("l_tax") * -10).alias("logp_old"),
        ((F.col("l_discount") + F.col("l_tax")) * -5).alias("logp_ref"),
        F.col("q").alias("gen_len"),
        F.when(kind == 0, "Let's ... <think> ... </think> ...")
        .when(kind == 1, "Let's ... <th1nk> ... </think> ...")
        .when(kind == 2, "Let's ... </think> ... <think> ...")
        .otherwise("Let's ... <think> ...")
        .alias("text"),
    )


def v_tokens(t) -> DataFrame:
    types = F.array(*[F.lit(e) for e in EVENT_TYPES])
    sums = (
        t.events.select(
            F.col("user_id").alias("seq_id"),
            (F.dayofmonth("ts") - 1).cast("long").alias("pos"),
            F.array_position(types, F.col("event_type")).cast("long").alias("token_id"),
            F.col("value").cast("decimal(18,2)").alias("v"),
        )
        .groupBy("seq_id", "pos", "token_id")
        .agg(F.sum("v").cast("double").alias("mass"))
    )
    # A position whose values are all zero has no shares: 0 / 0 is NaN in the SQL.
    total = F.sum("mass").over(W.partitionBy("seq_id", "pos"))
    shares = sums.withColumn("total", total).withColumn("p", float_divide(F.col("mass"), F.col("total")))
    return shares.select(
        "seq_id", "pos", "token_id",
        (F.col("mass") / 10).alias("logit"), "p",
        float_log(F.col("p")).alias("logp"),
        F.lit(5).cast("long").alias("prompt_len"),
    )


def v_votes(t) -> DataFrame:
    win = F.col("o_custkey") % 7
    lose = (F.col("o_custkey") % 7 + 1 + F.col("o_orderkey") % 6) % 7
    return t.orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("arena"),
        F.concat(F.lit("m"), win.cast("string")).alias("winner"),
        F.concat(F.lit("m"), lose.cast("string")).alias("loser"),
    )


def v_mcq(t) -> DataFrame:
    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"))
                        for i, x in enumerate("ABCD")])
    return t.part.select("p_partkey", "p_brand", "p_size", F.explode(options).alias("o")).select(
        F.col("p_partkey").alias("item"),
        F.col("p_brand").alias("subset"),
        (F.col("p_size") % 4).alias("answer_idx"),
        F.col("o.x").alias("letter"),
        (-((F.col("p_partkey") * (F.col("o.i") + 3) * 7919) % 1000) / 1000.0).alias("logp"),
    )


def v_money(t) -> DataFrame:
    b = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    kind = F.col("c_custkey") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit("$"), b))
        .when(kind == 1, F.concat(F.lit("EUR "), b))
        .when(kind == 2, F.concat(b, F.lit("%")))
        .when(kind == 3, F.concat(F.lit("Age: "), F.col("c_nationkey").cast("string")))
        .when(kind == 4, F.lit("n/a"))
    )
    return t.customer.select(F.col("c_custkey").alias("id"), raw.alias("raw"))


def v_terms(t) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in TERMS], "term string")


def v_headers(t) -> DataFrame:
    return t.spark.createDataFrame(HEADERS, "file string, pos int, header string")


def v_metrics(t) -> DataFrame:
    return t.orders.select(
        F.year("o_orderdate").alias("epoch"),
        F.col("o_orderkey").alias("total_steps"),
        (F.col("o_totalprice") / 1e5).alias("train_loss"),
        (F.col("o_totalprice") / 2e5).alias("val_loss"),
    )


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")"
        for row in rows
    )


_TYPES_SQL = "[" + ", ".join(f"'{e}'" for e in EVENT_TYPES) + "]"

VIEW_SQL: dict[str, str] = {
    "v_lines": _LINES_SQL,
    "v_answers": """
  SELECT l_orderkey || ':' || lk AS index, l_returnflag AS subset, CAST(q AS VARCHAR) AS gtruth_answer,
    CASE lk % 6 WHEN 0 THEN 'Work. \\boxed{' || q || '}'
      WHEN 1 THEN '\\boxed{\\frac{' || (2*q) || '}{2}}'
      WHEN 2 THEN 'The answer is ' || q || '.'
      WHEN 3 THEN '\\boxed{' || (q+1) || '}'
      WHEN 4 THEN 'no result'
      ELSE '\\boxed{' || q || '} then \\boxed{ {' || q || '} }' END AS generated_text,
    lk, q FROM v_lines""",
    "v_samples": """
  SELECT l_orderkey AS item, lk AS sample_idx, CAST(l_suppkey % 3 AS VARCHAR) AS answer,
    'full ' || (l_suppkey % 3) || ' #' || lk AS full_text, l_discount AS score FROM v_lines""",
    "v_rollouts": """
  SELECT l_orderkey // 100 AS step, l_orderkey AS prompt_id, lk AS rollout_id,
    CAST(l_returnflag = 'R' AS DOUBLE) AS reward, CAST(l_linestatus = 'F' AS DOUBLE) AS format_reward,
    l_discount * -10 AS logp_new, l_tax * -10 AS logp_old, (l_discount + l_tax) * -5 AS logp_ref,
    q AS gen_len, CASE lk % 4 WHEN 0 THEN 'Let''s ... <think> ... </think> ...'
      WHEN 1 THEN 'Let''s ... <th1nk> ... </think> ...'
      WHEN 2 THEN 'Let''s ... </think> ... <think> ...'
      ELSE 'Let''s ... <think> ...' END AS text FROM v_lines""",
    "v_tokens": f"""
  SELECT seq_id, pos, token_id, mass / 10 AS logit, p, ln(p) AS logp, CAST(5 AS BIGINT) AS prompt_len
  FROM (SELECT *, mass / sum(mass) OVER (PARTITION BY seq_id, pos) AS p FROM (
    SELECT user_id AS seq_id, CAST(day(ts) - 1 AS BIGINT) AS pos,
      CAST(list_position({_TYPES_SQL}, event_type) AS BIGINT) AS token_id,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS mass FROM events GROUP BY ALL))""",
    "v_votes": """
  SELECT o_orderkey AS seq, o_orderpriority AS arena, 'm' || (o_custkey % 7) AS winner,
    'm' || ((o_custkey % 7 + 1 + o_orderkey % 6) % 7) AS loser FROM orders""",
    "v_mcq": """
  SELECT p_partkey AS item, p_brand AS subset, p_size % 4 AS answer_idx, o.x AS letter,
    -((p_partkey * (o.i + 3) * 7919) % 1000) / 1000.0::DOUBLE AS logp
  FROM part, (VALUES (0,'A'),(1,'B'),(2,'C'),(3,'D')) o(i, x)""",
    "v_money": """
  SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '$' || b WHEN 1 THEN 'EUR ' || b
    WHEN 2 THEN b || '%' WHEN 3 THEN 'Age: ' || c_nationkey WHEN 4 THEN 'n/a' END AS raw
  FROM (SELECT *, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS b FROM customer)""",
    "v_terms": f"SELECT * FROM (VALUES {_values([(x,) for x in TERMS])}) v(term)",
    "v_headers": f"SELECT * FROM (VALUES {_values(HEADERS)}) v(file, pos, header)",
    "v_metrics": """
  SELECT CAST(year(o_orderdate) AS INTEGER) AS epoch, o_orderkey AS total_steps, o_totalprice / 1e5 AS train_loss,
    o_totalprice / 2e5 AS val_loss FROM orders""",
}
_NEEDS_LINES = {"v_answers", "v_samples", "v_rollouts"}


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` with the named views in front as common table expressions."""
    body = body.strip().rstrip(";")
    needed = list(names)
    if _NEEDS_LINES & set(needed) and "v_lines" not in needed:
        needed.insert(0, "v_lines")
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in needed)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
