"""Profiles, roles, counts and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions import text as X
from answerloom.functions.common import round6
from answerloom.operators import ordering
from answerloom.operators import profiles as O

_LINE_COLS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


def _profile_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(CAST(sum(CAST({c} AS DECIMAL(28,2))) AS DOUBLE), 2)
            AS sum, round(avg({c}), 6) + 0.0 AS avg, CAST(min({c}) AS DOUBLE) AS min,
            CAST(max({c}) AS DOUBLE) AS max FROM {table}"""
        for c in columns
    )


def _rounded_profile(df):
    return df.withColumns({"sum": F.round("sum", 2), "avg": round6(F.col("avg"))})


@query("a1_numeric_profile", _profile_sql("lineitem", _LINE_COLS))
def _(t):
    return _rounded_profile(O.numeric_profile(t.lineitem))


@query(
    "a2_column_roles",
    """SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'),
         ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderdate', 'date'),
         ('o_orderpriority', 'categorical')) v("column", role)
       CROSS JOIN (SELECT count(*) AS tested FROM orders)""",
)
def _(t):
    text = t.orders.select(*[F.col(c).cast("string") for c in t.orders.columns])
    return O.column_roles(text).select("column", "role", "tested")


@query(
    "a3_group_averages",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS group_column, CAST({c} AS VARCHAR) AS group_value, '{n}' AS number_column,
            round(avg({n}), 6) + 0.0 AS average FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY {c}"""
        for c in ("c_mktsegment", "o_orderstatus", "o_orderpriority")
        for n in ("c_acctbal", "o_totalprice")
    ),
)
def _(t):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    out = O.group_averages(
        rows, ["c_mktsegment", "o_orderstatus", "o_orderpriority"], ["c_acctbal", "o_totalprice"]
    )
    return out.withColumn("average", round6(F.col("average")))


@query("a4_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return O.value_counts(t.events, "event_type")


@query(
    "a5_distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n, count(DISTINCT {c}) > 5 AS many FROM part"
        for c in ("p_name", "p_brand", "p_type", "p_size")
    ),
)
def _(t):
    return O.distinct_counts(t.part, ["p_name", "p_brand", "p_type", "p_size"])


@query(
    "a6_text_shape",
    r"""SELECT doc_id, len(lines) AS rows, len(list_distinct(list_filter(
          regexp_split_to_array(lines[1], '\s+'), lambda w: w <> ''))) AS columns
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') AS lines
          FROM documents)""",
)
def _(t):
    return O.text_shape(t.documents, "doc_id", "text")


@query("a6_table_shape", "SELECT count(*) AS rows, CAST(5 AS INTEGER) AS columns FROM documents")
def _(t):
    return O.table_shape(t.documents)


_SIZE = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


@query(
    "a16_field_lengths",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS field, round(avg(n), 6) + 0.0 AS avg_tokens, min(n) AS min_tokens,
            max(n) AS max_tokens, count(*) AS count FROM (SELECT {_SIZE.format(c)} AS n FROM conversations)"""
        for c in ("role", "text")
    ),
)
def _(t):
    out = O.field_lengths(t.conversations, ["role", "text"])
    return out.withColumn("avg_tokens", round6(F.col("avg_tokens")))


@query(
    "a16_json_field_lengths",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS field, round(avg(n), 6) + 0.0 AS avg_tokens, min(n) AS min_tokens,
            max(n) AS max_tokens, count(*) AS count
            FROM (SELECT {_SIZE.format('CAST(' + c + ' AS VARCHAR)')} AS n FROM documents)"""
        for c in ("doc_id", "lang", "source", "text")
    ),
)
def _(t):
    raw = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    out = O.json_field_lengths(t.documents.select(raw.alias("raw")), "raw")
    return out.withColumn("avg_tokens", round6(F.col("avg_tokens")))


@query(
    "a17_length_summary",
    f"""WITH s AS (SELECT doc_id AS i, {_SIZE.format('text')} AS n FROM documents)
        SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS average, min(n) AS shortest,
          arg_min(i, (n, i)) AS shortest_index, max(n) AS longest, arg_max(i, (n, -i)) AS longest_index
        FROM s""",
)
def _(t):
    return O.length_summary(t.documents, "doc_id", X.token_count("text"))


_Q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    "a20_quantiles",
    " UNION ALL ".join(
        f"""SELECT {q}::DOUBLE AS q, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i,
            count(*) OVER () AS n FROM events) WHERE i = CAST(floor({q}::DOUBLE * n) AS BIGINT)"""
        for q in _Q
    ),
)
def _(t):
    return O.nearest_rank_quantiles(t.events, "value", _Q)


@query(
    "a20_mean_and_deviation",
    """SELECT round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std,
       count(value) AS n FROM events""",
)
def _(t):
    out = O.mean_and_deviation(t.events, "value")
    return out.withColumns({"mean": round6(F.col("mean")), "std": round6(F.col("std"))})


@query(
    "a20_rounded_frequencies",
    "SELECT round_even(value, 0) AS value, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    return O.rounded_frequencies(t.events, "value", 0)


@query(
    "a24_merged_profile",
    """SELECT 'name_length' AS "column", count(*) AS count, CAST(sum(n) AS DOUBLE) AS sum,
         round(avg(n), 6) + 0.0 AS avg, CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max
       FROM (SELECT length(c_name) AS n FROM customer UNION ALL SELECT length(s_name) FROM supplier)
       UNION ALL """
    + _profile_sql("customer", ["c_acctbal"])
    + " UNION ALL "
    + _profile_sql("supplier", ["s_acctbal"]),
)
def _(t):
    people = t.customer.select(F.length("c_name").alias("name_length"), "c_acctbal")
    firms = t.supplier.select(F.length("s_name").alias("name_length"), "s_acctbal")
    return _rounded_profile(O.numeric_profile(ordering.union_headers([people, firms])))


@query(
    "a25_metric_per_file",
    """SELECT l_shipmode_file AS file, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))
         - CAST(l_quantity * 1000 AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, count(*) AS rows
       FROM (SELECT *, 'file_' || l_returnflag AS l_shipmode_file FROM lineitem) GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.withColumn("file", F.concat(F.lit("file_"), "l_returnflag"))
    metric = X.profit("l_extendedprice", F.col("l_quantity") * 1000).cast("decimal(18,2)")
    out = O.metric_per_file(rows, "file", metric)
    return out.withColumn("total", F.round(F.col("total").cast("double"), 2))


@query(
    "d8_chart_bars",
    "SELECT o_orderpriority AS label, o_totalprice AS value FROM orders",
)
def _(t):
    return O.chart_bars(t.orders, "o_orderpriority", "o_totalprice")


@query(
    "d8_chart_line",
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index, o_totalprice AS value
       FROM orders""",
)
def _(t):
    return O.chart_line(t.orders, [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")


@query(
    "d8_chart_timeline_unlabelled",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate, '%Y-%m-%d') AS "end",
         '' || (row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderkey) - 1) AS label,
         NULL::VARCHAR AS "group", '' || (row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderkey) - 1)
         AS colour FROM orders""",
)
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.select(day.alias("start"), day.alias("end"), "o_totalprice", "o_orderkey")
    return O.chart_timeline(rows, [F.col("start"), F.col("o_totalprice"), F.col("o_orderkey")])


@query(
    "d8_chart_timeline",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d')
         AS "end", CAST(o_orderkey AS VARCHAR) AS label, o_orderpriority AS "group",
       CAST(o_custkey AS VARCHAR) AS colour FROM orders""",
)
def _(t):
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd").alias("end_date"),
        F.col("o_orderkey").alias("task_name"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_custkey").alias("owner"),
    )
    return O.chart_timeline(rows)
