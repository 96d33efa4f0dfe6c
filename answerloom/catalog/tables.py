"""Filters, projections, limits, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import matching_sql, TABLE_NAMES, query
from answerloom.functions import text as X
from answerloom.functions.common import round6
from answerloom.operators import filters as R
from answerloom.operators import ordering as O
from answerloom.plans import views as V

_PARSE_SQL = r"""CASE WHEN regexp_matches(d, '^-?(\d+(\.\d*)?|\.\d+)$') THEN TRY_CAST(d AS DOUBLE) END"""
_DIGITS_SQL = (
    r"regexp_replace(regexp_replace(trim(raw), "
    r"'(USD|EUR|GBP|JPY|CFA|NGN|INR|CAD|AUD|CHF|₦|₿|¥|€|£|\$)', '', 'gi'), '[^\d.\-]', '', 'g')"
)


@query(
    "x1_parse_numeric",
    f"SELECT id, raw, {_PARSE_SQL} AS value FROM (SELECT *, {_DIGITS_SQL} AS d FROM v_money)",
    ("v_money",),
)
def _(t):
    return V.v_money(t).select("id", "raw", X.parse_numeric("raw").alias("value"))


@query(
    "f1_numeric_filter",
    f"""SELECT id, raw FROM (SELECT id, raw, {_PARSE_SQL} AS value
        FROM (SELECT *, {_DIGITS_SQL} AS d FROM v_money)) WHERE value >= 1000""",
    ("v_money",),
)
def _(t):
    return V.v_money(t).where(R.numeric_condition("raw", 1000, ">="))


@query(
    "f2_contains_any",
    """SELECT p_partkey, p_name FROM part
       WHERE contains(lower(trim(p_name)), 'red') OR contains(lower(trim(p_name)), 'ring')""",
)
def _(t):
    return t.part.select("p_partkey", "p_name").where(R.contains_any("p_name", ["red", "ring"]))


_CONDITIONS = [
    ("o_totalprice", 200000, ">", "AND"),
    ("o_orderstatus", ["f", "o"], "==", "AND"),
    ("o_orderpriority", ["urgent", "high"], "==", "OR"),
    ("o_custkey", 700, "<=", "AND"),
]
_CONDITIONS_SQL = """((o_totalprice > 200000 AND (contains(lower(o_orderstatus), 'f')
  OR contains(lower(o_orderstatus), 'o'))) OR contains(lower(o_orderpriority), 'urgent')
  OR contains(lower(o_orderpriority), 'high')) AND o_custkey <= 700"""


@query("f3_condition_list", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_CONDITIONS_SQL}")
def _(t):
    return t.orders.where(R.fold_conditions(_CONDITIONS)).select("o_orderkey", "o_custkey")


@query(
    "f4_equal_ignoring_case",
    "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey = 3",
)
def _(t):
    keep = R.equals_ignoring_case({"c_mktsegment": "Building", "c_nationkey": 3})
    return t.customer.where(keep).select("c_custkey")


@query(
    "f6_present_and_above",
    """SELECT c_custkey, c_acctbal FROM customer
       WHERE c_acctbal IS NOT NULL AND c_acctbal <> 0 AND c_acctbal > 7000""",
)
def _(t):
    keep = R.present_and_above("c_acctbal", 7000)
    return t.customer.where(keep).select("c_custkey", "c_acctbal")


@query(
    "f7_drop_blank",
    "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')",
)
def _(t):
    return R.drop_blank_text(R.drop_blank_rows(t.documents), "text").select("doc_id", "lang")


@query(
    "f8_fixed_projection",
    """SELECT coalesce(s_name, '') AS s_name, '' AS s_phone,
       coalesce(CAST(s_suppkey AS VARCHAR), '') AS s_suppkey FROM supplier""",
)
def _(t):
    return R.project_with_defaults(t.supplier, ["s_name", "s_phone", "s_suppkey"])


@query(
    "f10_preview",
    "SELECT doc_id, substr(text, 1, 200) AS head FROM documents ORDER BY doc_id LIMIT 20",
)
def _(t):
    head = F.substring("text", 1, 200).alias("head")
    return R.preview(t.documents, ["doc_id"], 20).select("doc_id", head)


_SIZE_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query(
    "f11_length_filter",
    f"""SELECT count(*) AS original, count(*) FILTER (WHERE n <= 300) AS filtered,
        count(*) FILTER (WHERE n > 300) AS removed FROM (SELECT {_SIZE_SQL} AS n FROM documents)""",
)
def _(t):
    return R.length_filter_report(t.documents, X.token_count("text"), 300)


@query(
    "f12_valid_split",
    """SELECT valid, count(*) AS n FROM (SELECT length(text) >= 200 AND lang <> 'fr' AS valid
       FROM documents) GROUP BY valid""",
)
def _(t):
    valid = (F.length("text") >= 200) & (F.col("lang") != "fr")
    good, rejected = R.split_valid(t.documents, valid)
    tagged = good.select(F.lit(True).alias("valid")).union(rejected.select(F.lit(False)))
    return tagged.groupBy("valid").agg(F.count("*").alias("n"))


@query(
    "f14_head",
    "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10",
)
def _(t):
    return R.preview(t.benchmark, ["item_id"], 10)


@query(
    "t1_most_recent",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
       ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""",
)
def _(t):
    latest = R.preview(t.orders, [F.desc("o_orderdate"), "o_orderkey"], 10)
    return latest.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "t3_page",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 90",
)
def _(t):
    return R.page(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 3)


@query("t4_oversize_guard", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2000")
def _(t):
    return R.preview(t.orders.select("o_orderkey"), ["o_orderkey"], 2000)


@query(
    "t6_length_order",
    f"""SELECT doc_id, n, row_number() OVER (ORDER BY n, doc_id) - 1 AS pos
        FROM (SELECT doc_id, {_SIZE_SQL} AS n FROM documents)""",
)
def _(t):
    sized = t.documents.select("doc_id", X.token_count("text").alias("n"))
    return O.group_positions(sized, (), [F.col("n"), F.col("doc_id")])


_A_SQL = "o_totalprice > 300000"
_B_SQL = "o_orderstatus = 'F'"


@query("u1_either", f"SELECT o_orderkey FROM orders WHERE {_A_SQL} OR {_B_SQL}")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    left = rows.where(F.col("o_totalprice") > 300000).select("o_orderkey")
    right = rows.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return O.rows_of_either(left, right, "o_orderkey")


@query("u2_both", f"SELECT o_orderkey FROM orders WHERE {_A_SQL} AND {_B_SQL}")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    left = rows.where(F.col("o_totalprice") > 300000).select("o_orderkey")
    return O.rows_of_both(left, rows.where(F.col("o_orderstatus") == "F"), "o_orderkey")


@query(
    "u3_union_headers",
    """SELECT c_custkey, c_name AS name, c_acctbal, NULL AS s_suppkey FROM customer
       UNION ALL SELECT NULL, s_name, NULL, s_suppkey FROM supplier""",
)
def _(t):
    people = t.customer.select("c_custkey", F.col("c_name").alias("name"), "c_acctbal")
    return O.union_headers([people, t.supplier.select("s_suppkey", F.col("s_name").alias("name"))])


@query(
    "u4_distinct_models",
    """SELECT model FROM (SELECT winner AS model FROM v_votes UNION SELECT loser FROM v_votes)""",
    ("v_votes",),
)
def _(t):
    from answerloom.operators.boards import models

    return models(V.v_votes(t))


@query(
    "u5_train_validation",
    """SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY md5('123:' || doc_id) DESC, doc_id) <= 50
         THEN 'validation' ELSE 'train' END AS part FROM documents""",
)
def _(t):
    train, validation = O.train_validation_split(t.documents.select("doc_id", "lang"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(
        validation.withColumn("part", F.lit("validation"))
    )


@query(
    "a22_table_sizes",
    " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLE_NAMES),
)
def _(t):
    from answerloom.operators.profiles import table_sizes

    return table_sizes({name: getattr(t, name) for name in TABLE_NAMES})


@query(
    "x2_end_date",
    """SELECT o_orderkey, strftime(o_orderdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY,
         '%Y-%m-%d') AS until, l_linenumber, l_partkey, l_suppkey
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    until = F.date_format(X.end_date(start, "l_quantity"), "yyyy-MM-dd")
    return lines.select("o_orderkey", until.alias("until"), "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "x3_profit",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(l_extendedprice - l_quantity * 1000, 6) + 0.0 AS profit FROM lineitem""",
)
def _(t):
    profit = X.profit(F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round6(profit).alias("profit")
    )


_TAG_SQL = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{d}'"
        for d, w in X.DOMAIN_KEYWORDS
    )
    + " END"
)


@query("x13_domain_tag", f"SELECT doc_id, {_TAG_SQL} AS tag FROM documents")
def _(t):
    return t.documents.select("doc_id", X.domain_tag("text").alias("tag"))


@query(
    "x14_similarity",
    matching_sql("SELECT DISTINCT replace(lower(p_name), ' ', '') AS a0, replace(lower(p_type), ' ', '') AS b0 FROM part")
    + """ SELECT p_partkey, round(score, 6) + 0.0 AS score FROM part JOIN ratio
        ON a0 = replace(lower(p_name), ' ', '') AND b0 = replace(lower(p_type), ' ', '')""",
)
def _(t):
    return t.part.select("p_partkey", round6(X.similarity("p_name", "p_type")).alias("score"))


@query(
    "x15_text_chunks",
    """SELECT doc_id, CAST(s // 900 AS BIGINT) AS pos, substr(text, CAST(s AS BIGINT) + 1, 1000) AS chunk
       FROM (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS s FROM documents)""",
)
def _(t):
    pieces = F.posexplode(X.text_chunks("text", 1000, 100)).alias("pos", "chunk")
    return t.documents.select("doc_id", pieces).withColumn("pos", F.col("pos").cast("long"))


@query(
    "udtf1_piece_rows",
    """SELECT conv_id, turn, 'chunk' AS kind, CAST(s // 50 AS INTEGER) AS pos,
         substr(text, CAST(s AS BIGINT) + 1, 60) AS piece
       FROM (SELECT conv_id, turn, text, unnest(range(0, length(text), 50)) AS s FROM conversations)
       UNION ALL
       SELECT conv_id, turn, 'line', CAST(i - 1 AS INTEGER), string_split(text, chr(10))[i]
       FROM (SELECT conv_id, turn, text, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i
             FROM conversations)""",
)
def _(t):
    kinds = {"chunk": X.text_chunks("text", 60, 10), "line": F.split("text", "\n")}
    parts = [
        t.conversations.select("conv_id", "turn", F.lit(k).alias("kind"), F.posexplode(c).alias("pos", "piece"))
        for k, c in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query("x16_token_count", f"SELECT doc_id, {_SIZE_SQL} AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", X.token_count("text").alias("n"))


@query(
    "x17_row_blocks",
    """SELECT block, count(*) AS n, min(o_orderkey) AS first_key FROM (
       SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500 AS BIGINT)
         AS block FROM orders) GROUP BY block""",
)
def _(t):
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    blocks = O.row_blocks(t.orders.select("o_orderdate", "o_orderkey"), order, 500)
    return blocks.groupBy("block").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")
    )


@query(
    "x18_text_slices",
    """SELECT doc_id, CAST(s // 4000 AS BIGINT) AS pos, substr(text, CAST(s AS BIGINT) + 1, 4000) AS piece
       FROM (SELECT doc_id, text, unnest(range(0, length(text), 4000)) AS s FROM documents)
       WHERE s // 4000 < 10""",
)
def _(t):
    # The first ten slices are the documented behaviour of the summary split.
    pieces = F.posexplode(X.text_slices("text", 4000, limit=10)).alias("pos", "piece")
    return t.documents.select("doc_id", pieces).withColumn("pos", F.col("pos").cast("long"))


@query(
    "x19_row_text",
    """SELECT c_custkey, 'c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment ||
       ' | c_nationkey: ' || c_nationkey AS line, c_name || ' ' || c_mktsegment AS cells FROM customer""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        X.row_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("line"),
        X.row_values_text(["c_name", "c_mktsegment"]).alias("cells"),
    )


@query(
    "x21_judge_score",
    r"""SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text, '([1-5])(?:\D|\z)', 1) AS INTEGER), 3)
        AS score FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.judge_score("text").alias("score"))


@query(
    "x22_first_choice",
    """SELECT doc_id, upper(nullif(regexp_extract(text, '([A-Da-d])', 1), '')) AS choice
       FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.first_choice("text").alias("choice"))


@query(
    "x23_gold_choice",
    """SELECT item, letter, substr('ABCD', answer_idx + 1, 1) AS from_index,
       substr(upper(trim(letter)), 1, 1) AS from_letter FROM v_mcq""",
    ("v_mcq",),
)
def _(t):
    return V.v_mcq(t).select(
        "item", "letter",
        X.gold_choice("answer_idx").alias("from_index"),
        X.gold_choice(F.lower("letter")).alias("from_letter"),
    )


@query(
    "x26_slug",
    """SELECT p_partkey, lower(trim(regexp_replace(p_name || ' (' || p_brand || ')',
       '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM part""",
)
def _(t):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t.part.select("p_partkey", X.slug(name).alias("slug"))


@query(
    "x27_last_tokens",
    r"""SELECT conv_id, turn, array_to_string(list_slice(a, greatest(1, len(a) - 15), len(a)), ' ')
        AS kept FROM (SELECT conv_id, turn,
          regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS a FROM conversations)""",
)
def _(t):
    kept = F.array_join(X.last_items(X.tokens("text"), 16), " ")
    return t.conversations.select("conv_id", "turn", kept.alias("kept"))
