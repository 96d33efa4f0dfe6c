"""Keyed alignment, term lookup and header resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import matching_sql, query
from answerloom.operators import filters as R
from answerloom.operators import joins as O
from answerloom.plans import views as V


@query(
    "j2_remaining",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    return O.remaining(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "j2_resume_mismatches",
    "SELECT doc_id, lang || '!' AS lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
)
def _(t):
    rows = t.documents.select("doc_id", "lang")
    changed = F.when(F.col("toxic") == 1, F.concat("lang", F.lit("!"))).otherwise(F.col("lang"))
    done = t.labels.join(rows, "doc_id").select("doc_id", changed.alias("lang"))
    return O.resume_mismatches(rows, done, "doc_id", "lang")


@query(
    "j3_terms_in_text",
    "SELECT doc_id, term FROM documents, v_terms WHERE contains(lower(text), term)",
    ("v_terms",),
)
def _(t):
    return O.terms_in_text(t.documents, "doc_id", "text", V.v_terms(t), "term")


_WORDS_SQL = r"""terms AS (SELECT DISTINCT lower(w) AS term FROM (
  SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM benchmark))"""


@query(
    "j3_terms_in_text_joined",
    f"WITH {_WORDS_SQL} SELECT doc_id, term FROM documents, terms WHERE contains(lower(text), term)",
)
def _(t):
    word = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("term")
    return O.joined_terms_in_text(t.documents, "doc_id", "text", t.benchmark.select(word), "term")


@query(
    "f9_extract_keywords",
    r"""WITH terms AS (SELECT DISTINCT lower(trim(v)) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS v
          FROM benchmark) WHERE trim(v) <> ''),
        hits AS (SELECT doc_id, term AS keyword FROM documents, terms WHERE contains(lower(text), term)),
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS a
          FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits))
        SELECT * FROM hits UNION ALL
        SELECT doc_id, array_to_string(list_slice(a, greatest(1, len(a) - 2), len(a)), ' ') FROM w""",
)
def _(t):
    values = t.benchmark.select(F.explode(F.split("text", "\n")).alias("value"))
    return O.extract_keywords(t.documents, "doc_id", "text", values, "value")


def _dictionary_sql() -> str:
    rows = ", ".join(
        f"('{target}', '{w.replace(' ', '').lower()}')"
        for target, words in O.SYNONYMS.items()
        for w in words
    )
    return f"syn AS (SELECT * FROM (VALUES {rows}) v(target, word))"


@query(
    "j5_resolve_headers",
    matching_sql(
        f"""WITH {_dictionary_sql()} SELECT DISTINCT replace(lower(x), ' ', '') AS a0, word AS b0 FROM syn, (
              SELECT unnest(string_split(p_name, ' ')) AS x FROM part UNION SELECT role FROM conversations)"""
    )
    + f""", {_dictionary_sql()}, h AS (SELECT conv_id AS file, role AS header, min(turn) AS pos,
          replace(lower(role), ' ', '') AS name FROM (SELECT p_partkey AS conv_id, i AS turn,
            string_split(p_name, ' ')[i] AS role FROM (SELECT *, unnest(range(1, 1 + len(string_split(p_name, ' '))))
            AS i FROM part) UNION ALL SELECT conv_id, turn + 100, role FROM conversations) GROUP BY conv_id, role),
        s AS (SELECT file, target, header, pos, bool_or(contains(name, word)) AS contained, max(score) AS score
          FROM h, syn, ratio WHERE a0 = name AND b0 = word GROUP BY ALL)
        SELECT file, target, header FROM s QUALIFY row_number() OVER (PARTITION BY file, target ORDER BY
          contained DESC, CASE WHEN contained THEN 1.0 ELSE score END DESC, pos) = 1
          AND (contained OR score >= 0.6)""",
)
def _(t):
    words = t.part.select(F.col("p_partkey").alias("conv_id"), F.posexplode(F.split("p_name", " ")))
    words = words.select("conv_id", (F.col("pos") + 1).alias("turn"), F.col("col").alias("role"))
    roles = t.conversations.select("conv_id", F.col("turn") + 100, "role")
    headers = words.unionAll(roles).groupBy(F.col("conv_id").alias("file"), F.col("role").alias("header"))
    return O.resolve_headers(headers.agg(F.min("turn").alias("pos")))


_MESSAGE = "average economic promo parts"


@query(
    "j6_best_header",
    matching_sql(f"SELECT DISTINCT p_type AS a0, unnest(string_split('{_MESSAGE}', ' ')) AS b0 FROM part")
    + f""", h AS (SELECT p_brand AS file, p_type AS header, min(p_partkey) AS pos FROM part GROUP BY ALL),
        w AS (SELECT unnest(string_split('{_MESSAGE}', ' ')) AS word, unnest(range(1, 5)) AS i),
        s AS (SELECT file, header, pos, contains('{_MESSAGE}', lower(header)) AS inside, i, score
          FROM h, w, ratio WHERE a0 = header AND b0 = word),
        b AS (SELECT file, header, pos, inside, min(i) FILTER (WHERE score >= 0.6) AS hit FROM s GROUP BY ALL),
        r AS (SELECT b.*, CASE WHEN b.inside THEN 0 WHEN hit IS NOT NULL THEN 1 ELSE 2 END AS tier, s.score
          FROM b LEFT JOIN s ON s.file = b.file AND s.header = b.header AND s.i = b.hit)
        SELECT file, header, CAST(tier AS INTEGER) AS tier FROM r QUALIFY row_number() OVER (PARTITION BY file
          ORDER BY tier, CASE WHEN tier = 1 THEN hit ELSE 0 END, CASE WHEN tier = 1 THEN -score ELSE 0 END,
            CASE WHEN tier = 1 THEN header ELSE '' END DESC, pos) = 1""",
)
def _(t):
    headers = t.part.groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("header"))
    return O.best_header_per_file(headers.agg(F.min("p_partkey").alias("pos")), _MESSAGE)


def _label_sql(field: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.LABELS[field].items())
    return f"CASE lang {whens} ELSE '{O.LABELS[field]['en']}' END AS label_{field}"


@query(
    "j7_localised_labels",
    "SELECT doc_id, " + ", ".join(_label_sql(f) for f in O.LABELS) + " FROM documents",
)
def _(t):
    return t.documents.select("doc_id", *O.localised_labels(F.col("lang")))


_RULES = {
    "large": [("o_totalprice", 400000, ">", "AND")],
    "urgent_open": [
        ("o_orderpriority", ["urgent"], "==", "AND"),
        ("o_orderstatus", ["o"], "==", "AND"),
    ],
    "small_or_low": [
        ("o_totalprice", 2000, "<", "AND"),
        ("o_orderpriority", ["low"], "==", "OR"),
    ],
    "first_customers": [("o_custkey", 10, "<=", "AND")],
    "never": [("o_totalprice", 0, "!=", "AND")],
}


@query(
    "j9_rows_per_rule",
    """SELECT 'large' AS rule_id, o_orderkey FROM orders WHERE o_totalprice > 400000
       UNION ALL SELECT 'urgent_open', o_orderkey FROM orders
         WHERE contains(lower(o_orderpriority), 'urgent') AND contains(lower(o_orderstatus), 'o')
       UNION ALL SELECT 'small_or_low', o_orderkey FROM orders
         WHERE o_totalprice < 2000 OR contains(lower(o_orderpriority), 'low')
       UNION ALL SELECT 'first_customers', o_orderkey FROM orders WHERE o_custkey <= 10""",
)
def _(t):
    return R.rows_per_rule(t.orders, _RULES).select("rule_id", "o_orderkey")


@query(
    "j10_reload_threads",
    """SELECT conv_id AS thread_id, turn AS position, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END
         AS role, c.text AS output, d.source AS file_name
       FROM conversations c LEFT JOIN documents d ON d.doc_id = conv_id
       WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') AND trim(c.text) <> ''""",
)
def _(t):
    threads = t.conversations.where(F.col("role") == "assistant")
    steps = t.conversations.select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"),
        F.col("role").alias("type"), F.col("text").alias("output"),
    )
    files = t.documents.select(
        F.col("doc_id").alias("thread_id"), F.col("source").alias("file_name")
    )
    return O.reload_threads(
        threads.select(F.col("conv_id").alias("thread_id")).distinct(), steps, files
    )
