"""Grading, rewards, prompts and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions import grading as G
from answerloom.functions import prompts as P
from answerloom.functions import text as X
from answerloom.functions.common import round6
from answerloom.functions.nested import response_fields
from answerloom.operators import evaluate as E
from answerloom.operators.training import user_assistant_pairs
from answerloom.plans import views as V

_A = ("v_answers",)
_BOX_SQL = r"""CASE lk % 6 WHEN 0 THEN '' || q WHEN 1 THEN '\frac{' || 2*q || '}{2}' WHEN 3 THEN '' || (q+1)
  WHEN 5 THEN ' {' || q || '} ' END"""
_CAND_SQL = r"""CASE lk % 6 WHEN 1 THEN '\frac{' || 2*q || '}{2}' WHEN 3 THEN '' || (q+1)
  WHEN 4 THEN 'no result' WHEN 5 THEN '{' || q || '}' ELSE '' || q END"""
_NORM_SQL = """CASE lk % 6 WHEN 1 THEN '(' || 2*q || ')/(2)' WHEN 3 THEN '' || (q+1)
  WHEN 4 THEN 'no result' ELSE '' || q END"""
_VERDICT_SQL = "CASE WHEN lk % 6 IN (3, 4) THEN 'wrong' ELSE 'correct' END"


@query("x4_last_boxed", f"SELECT index, {_BOX_SQL} AS boxed FROM v_answers", _A)
def _(t):
    return V.v_answers(t).select("index", G.last_boxed("generated_text").alias("boxed"))


@query("x5_final_candidate", f"SELECT index, {_CAND_SQL} AS candidate FROM v_answers", _A)
def _(t):
    return V.v_answers(t).select("index", G.final_candidate("generated_text").alias("candidate"))


@query("x6_normalize_answer", f"SELECT index, {_NORM_SQL} AS canonical FROM v_answers", _A)
def _(t):
    staged = V.v_answers(t).withColumn("candidate", G.final_candidate("generated_text"))
    return staged.select("index", G.normalize_answer("candidate").alias("canonical"))


@query(
    "x7_answer_parts",
    """SELECT index, gtruth_answer || ';' || subset AS parts, CAST(2 AS BIGINT) AS n FROM v_answers""",
    _A,
)
def _(t):
    listed = F.concat(F.lit("("), "gtruth_answer", F.lit(" , "), "subset", F.lit(")"))
    parts = V.v_answers(t).select("index", G.answer_parts(listed).alias("p"))
    return parts.select(
        "index", F.array_join("p", ";").alias("parts"), F.size("p").cast("long").alias("n")
    )


# fixed values: pairs of truth and answer with their verdict
GOLDEN = [
    ("3/4", r"\frac{3}{4}", "correct"), ("(3)/(4)", "3/4", "correct"),
    ("1/2", "0.5", "correct"), ("14/3", "15/3", "wrong"), ("(14/3, 2/3)", "(14/3, 4/6)", "correct"),
    ("(1, 2, 3)", "(1, 2)", "wrong"), ("[1, 2]", "[2, 1]", "wrong"), ("2", "3", "wrong"),
    ("34", "3 4", "wrong"), ("12", "3 4", "correct"), ("123", "1 2 3", "wrong"),
    ("0", "-0", "correct"), ("6", "2(3)", "correct"), ("12", "(3)(4)", "correct"),
    ("1024", "2^{10}", "correct"), ("9", "3^2", "correct"), ("8", "3^2", "wrong"),
    ("3.5", "3 1/2", "correct"), ("1234", "1,234", "correct"), ("50", r"50\%", "correct"),
    ("7", "no result", "wrong"), ("x", "5", "wrong"), ("5", "", "wrong"),
    (r"\sqrt{2}", "1.41", "needs_cas"), ("x+1", "1+x", "needs_cas"), ("-3", "3", "wrong"),
]
_GOLDEN_SQL = ", ".join(
    "('golden " + str(i) + "', '" + verdict + "')" for i, (_, _, verdict) in enumerate(GOLDEN)
)


@query(
    "x8_grade",
    f"""SELECT index, {_VERDICT_SQL} AS verdict FROM v_answers
        UNION ALL SELECT * FROM (VALUES {_GOLDEN_SQL}) v(index, verdict)""",
    _A,
)
def _(t):
    rows = E.graded(V.v_answers(t), "generated_text", "gtruth_answer").select("index", "verdict")
    pairs = [(f"golden {i}", truth, answer) for i, (truth, answer, _) in enumerate(GOLDEN)]
    golden = t.spark.createDataFrame(pairs, "index string, truth string, answer string")
    return rows.unionByName(G.grade(golden, "answer", "truth").select("index", "verdict"))


@query(
    "x9_heuristic_score",
    r"""SELECT doc_id, round(CASE WHEN regexp_matches(text, '\d') THEN 1.0 ELSE 0.0 END
          + 1.5 * exp(-length(text) / 500.0), 6) + 0.0 AS score FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", round6(G.heuristic_score("text")).alias("score"))


@query(
    "x10_boxed_reward",
    "SELECT index, CASE WHEN lk % 6 IN (0, 1, 5) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM v_answers",
    _A,
)
def _(t):
    return G.rewards(V.v_answers(t), "generated_text", "gtruth_answer").select("index", "reward")


@query(
    "x11_partial_reward",
    """SELECT index, CASE lk % 6 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE
         AS partial_reward,
       CASE lk % 6 WHEN 2 THEN 1.0 WHEN 3 THEN 0.1 WHEN 4 THEN 0.0 ELSE 1.1 END::DOUBLE
         AS format_bonus_reward FROM v_answers""",
    _A,
)
def _(t):
    out = G.rewards(V.v_answers(t), "generated_text", "gtruth_answer")
    return out.select("index", "partial_reward", "format_bonus_reward")


@query(
    "x12_tag_order_reward",
    """SELECT prompt_id, rollout_id, CASE WHEN rollout_id % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS r
       FROM v_rollouts""",
    ("v_rollouts",),
)
def _(t):
    return V.v_rollouts(t).select("prompt_id", "rollout_id", P.tag_order_reward("text").alias("r"))


def _sql_text(name: str) -> str:
    text = P.PROMPTS[name].replace("'", "''")
    for placeholder, expr in {
        "{prompt}": "text", "{draft}": "text", "{critique}": "'item ' || item_id",
        "{reference}": "'' || item_id", "{answer}": "reverse(text)",
        "{option_a}": "'' || item_id", "{option_b}": "'' || (item_id + 1)",
        "{option_c}": "'' || (item_id + 2)", "{option_d}": "'' || (item_id + 3)",
    }.items():
        text = text.replace(placeholder, f"' || {expr} || '")
    return f"'{text}'"


@query(
    "x20_prompts",
    "SELECT item_id, " + ", ".join(f"{_sql_text(n)} AS {n}" for n in P.PROMPTS) + " FROM benchmark",
)
def _(t):
    item = F.col("item_id")
    columns = {
        "prompt": "text", "draft": "text",
        "critique": F.concat(F.lit("item "), item.cast("string")), "reference": item,
        "answer": F.reverse("text"), "option_a": item, "option_b": item + 1,
        "option_c": item + 2, "option_d": item + 3,
    }
    return t.benchmark.select("item_id", *[P.prompt(n, **columns).alias(n) for n in P.PROMPTS])


@query(
    "udf5_renderer",
    "SELECT doc_id, 'Text of ' || source || ':' || chr(10) || text || chr(10) || '{left}' AS prompt FROM documents",
)
def _(t):
    filled = P.render("Text of {source}:\n{text}\n{left}", source="source", text="text")
    return t.documents.select("doc_id", filled.alias("prompt"))


@query(
    "x12_tag_order_ids",
    """SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM documents""",
)
def _(t):
    kind = F.length("text") % 3
    # Tags before the prompt's end do not count; in the second kind they are swapped.
    ids = (
        F.when(kind == 0, F.array(*[F.lit(i) for i in (151668, 5, 151667, 6, 151668)]))
        .when(kind == 1, F.array(*[F.lit(i) for i in (151667, 5, 151668, 6, 151667)]))
        .otherwise(F.array(*[F.lit(i) for i in (151667, 151668, 7)]))
    )
    return t.documents.select("doc_id", P.tag_order_reward_ids(ids, F.lit(2)).alias("r"))


_PAIRS_SQL = """SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS reply FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'"""


@query(
    "x25_distilled_answer",
    f"""SELECT conv_id, turn, '<think>' || trim(prompt) || '</think>' || chr(10) || chr(10) || trim(reply)
          AS tagged, trim(prompt) || chr(10) || chr(10) || trim(reply) AS plain FROM ({_PAIRS_SQL})""",
)
def _(t):
    return user_assistant_pairs(t.conversations).select(
        "conv_id", "turn",
        P.distilled_answer("prompt", "reply").alias("tagged"),
        P.distilled_answer_plain("prompt", "reply").alias("plain"),
    )


@query(
    "x24_response_fields",
    """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 THEN NULL ELSE text END AS content,
         CASE (conv_id + turn) % 5 WHEN 0 THEN role WHEN 1 THEN '' WHEN 2 THEN role WHEN 3 THEN text END
         AS thinking, CASE WHEN (conv_id + turn) % 5 = 4 THEN 'no choices' END AS error
       FROM conversations""",
)
def _(t):
    kind = (F.col("conv_id") + F.col("turn")) % 5

    def message(**fields):
        return F.struct(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("message"))

    text, role = F.col("text"), F.col("role")
    part = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    raw = (
        F.when(kind == 0, F.to_json(F.struct(
            F.array(message(content=text, reasoning=role)).alias("choices"))))
        .when(kind == 1, F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices"))))
        .when(kind == 2, F.to_json(F.struct(
            F.array(message(content=part)).alias("choices"), role.alias("thinking"))))
        .when(kind == 3, F.to_json(F.struct(F.array(message(thinking=text)).alias("choices"))))
        .otherwise(F.lit('{"choices": [], "id": 1}'))
    )
    lines = t.conversations.select("conv_id", "turn", raw.alias("raw"))
    return lines.select("conv_id", "turn", response_fields("raw").alias("f")).select(
        "conv_id", "turn", "f.*"
    )


@query(
    "x24_event_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.select("event_id", value.alias("k"))


@query(
    "x31_boxed",
    "SELECT index, '\\boxed{' || gtruth_answer || '}' AS wrapped FROM v_answers",
    _A,
)
def _(t):
    return V.v_answers(t).select("index", P.boxed("gtruth_answer").alias("wrapped"))


@query(
    "x32_answer_class",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN
         CASE WHEN regexp_matches('' || p_partkey, '[89]') THEN 'plain' ELSE 'base_subscript' END WHEN 2 THEN
         'currency' WHEN 3 THEN 'tuple' ELSE 'plain' END AS kind,
       CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN
         CASE WHEN regexp_matches('' || p_partkey, '[89]') THEN 'needs_cas' ELSE p_partkey || '_8' END
         WHEN 2 THEN p_size || '000000.0' WHEN 3 THEN 'needs_cas' ELSE '' || p_size END AS canonical FROM part""",
)
def _(t):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("\\text{"), "p_name", F.lit("}")))
        .when(kind == 1, F.concat(key, F.lit("_{8}")))
        .when(kind == 2, F.concat(F.lit("\\$"), size, F.lit(",\\!000,\\!000")))
        .when(kind == 3, F.concat(F.lit("("), key, F.lit(", "), size, F.lit(")")))
        .otherwise(size)
    )
    answers = t.part.select("p_partkey", raw.alias("raw"))
    return answers.select(
        "p_partkey", G.answer_class("raw").alias("kind"), G.class_canonical("raw").alias("canonical")
    )


@query(
    "j1_match_predictions",
    "SELECT index, gtruth_answer, generated_text FROM v_answers",
    _A,
)
def _(t):
    answers = V.v_answers(t)
    return E.match_predictions(
        answers.select("index", "gtruth_answer"), answers.select("index", "generated_text"), "index"
    )


_COUNTS_SQL = """CAST(count(*) FILTER (WHERE verdict = 'correct') AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE verdict = 'wrong') AS BIGINT) AS wrong,
  CAST(count(*) FILTER (WHERE verdict = 'needs_cas') AS BIGINT) AS undecided, count(*) AS total"""


@query(
    "a7_accuracy",
    f"""SELECT *, round(correct / total, 6) + 0.0 AS accuracy FROM (
        SELECT subset, {_COUNTS_SQL} FROM (SELECT subset, {_VERDICT_SQL} AS verdict FROM v_answers)
        GROUP BY ROLLUP (subset))""",
    _A,
)
def _(t):
    graded = E.graded(V.v_answers(t), "generated_text", "gtruth_answer")
    return E.accuracy(graded, "subset").withColumn("accuracy", round6(F.col("accuracy")))


@query(
    "a7_label_accuracy",
    """SELECT source, CAST(sum(quality) AS BIGINT) AS correct, CAST(sum(1 - quality) AS BIGINT) AS wrong,
       CAST(0 AS BIGINT) AS undecided, count(*) AS total, round(avg(quality), 6) + 0.0 AS accuracy
       FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""",
)
def _(t):
    verdict = F.when(F.col("quality") == 1, "correct").otherwise("wrong")
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    out = E.accuracy(rows.withColumn("verdict", verdict), "source")
    return out.withColumn("accuracy", round6(F.col("accuracy")))


@query(
    "a8_accuracy_and_length",
    rf"""SELECT subset, correct, wrong, undecided, total, round(correct / total, 6) + 0.0 AS accuracy,
         round(n / total, 6) + 0.0 AS avg_tokens FROM (SELECT subset, {_COUNTS_SQL}, sum(n) AS n FROM (
         SELECT subset, {_VERDICT_SQL} AS verdict,
           len(regexp_extract_all(generated_text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS n
         FROM v_answers) GROUP BY ROLLUP (subset))""",
    _A,
)
def _(t):
    graded = E.graded(V.v_answers(t), "generated_text", "gtruth_answer")
    out = E.accuracy_with_length(graded, "subset", "generated_text")
    return out.withColumns(
        {"accuracy": round6(F.col("accuracy")), "avg_tokens": round6(F.col("avg_tokens"))}
    )


@query(
    "a18_score_histogram",
    r"""WITH s AS (SELECT coalesce(TRY_CAST(regexp_extract(text, '([1-5])(?:\D|\z)', 1) AS INTEGER), 3)
          AS score FROM documents)
        SELECT CAST(k AS INTEGER) AS score, (SELECT count(*) FROM s WHERE s.score = k) AS n,
          round((SELECT avg(score) FROM s), 6) + 0.0 AS mean_score FROM range(1, 6) r(k)""",
)
def _(t):
    scored = t.documents.select(X.judge_score("text").alias("score"))
    out = E.score_histogram(scored, "score")
    return out.withColumn("mean_score", round6(F.col("mean_score")))


@query(
    "a19_gold_distribution",
    """SELECT answer_idx, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS pct
       FROM v_mcq GROUP BY answer_idx""",
    ("v_mcq",),
)
def _(t):
    out = E.distribution(V.v_mcq(t), "answer_idx")
    return out.withColumn("pct", round6(F.col("pct")))


@query(
    "j8_gold_pairs",
    """SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END), ''),
         trim(text)) AS reference FROM conversations WHERE trim(text) <> ''""",
)
def _(t):
    answer = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ")
    rows = t.conversations.withColumn("answer", answer)
    return E.gold_pairs(rows, "text", "answer", "text").select("conv_id", "turn", "reference")


@query(
    "w13_running_accuracy",
    """SELECT seen, correct, round(correct / seen, 6) + 0.0 AS accuracy FROM (
         SELECT row_number() OVER (ORDER BY doc_id) AS seen,
           CAST(sum(quality) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS correct FROM labels)
       WHERE seen % 50 = 0""",
)
def _(t):
    out = E.running_accuracy(t.labels, [F.col("doc_id")], F.col("quality") == 1)
    return out.withColumn("accuracy", round6(F.col("accuracy")))
