"""Training-set preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions import text as X
from answerloom.functions.common import round6
from answerloom.functions.prompts import PROMPTS
from answerloom.operators import ordering
from answerloom.operators import training as O
from answerloom.plans import views as V

_TOK = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_ID = "list_transform({}, lambda x: CAST(('0x' || substr(md5(x), 1, 7))::BIGINT % 151936 AS INTEGER))"
EOS = 151645
PAD = 151643

_HEAD, _TAIL = (p.replace("'", "''") for p in PROMPTS["problem"].split("{prompt}"))
_PAIRS = f"""pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS reply FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'),
  tok AS (SELECT conv_id, turn, {_TOK.format(f"'{_HEAD}' || prompt || '{_TAIL}'")} AS p,
    {_TOK.format("'<think>' || trim(prompt) || '</think>' || chr(10) || chr(10) || trim(reply)")} AS a
    FROM pairs),
  ex AS (SELECT conv_id, turn, len(p) AS prompt_len,
    list_concat({_ID.format('list_concat(p, a)')}, [{EOS}]) AS ids FROM tok)"""


def _examples(t):
    pairs = O.user_assistant_pairs(t.conversations)
    return O.build_examples(pairs, ["conv_id", "turn"], "prompt", "prompt", "reply", EOS)


@query(
    "d1_build_examples",
    f"""WITH {_PAIRS} SELECT conv_id, turn, CAST(prompt_len AS INTEGER) AS prompt_len,
        CAST(len(ids) AS INTEGER) AS size, true AS valid FROM ex""",
)
def _(t):
    return _examples(t).select(
        "conv_id", "turn", "prompt_len", F.size("token_ids").alias("size"), "valid"
    )


@query(
    "x16_token_ids",
    f"SELECT conv_id, turn, array_to_string({_ID.format(_TOK.format('text'))}, ' ') AS ids FROM conversations",
)
def _(t):
    ids = F.array_join(X.token_ids("text").cast("array<string>"), " ")
    return t.conversations.select("conv_id", "turn", ids.alias("ids"))


@query(
    "d2_length_batches",
    f"""SELECT batch, count(*) AS n, min(len) AS shortest, max(len) AS longest FROM (
        SELECT len, (row_number() OVER (ORDER BY len, doc_id) - 1) // 32 AS batch FROM (
          SELECT doc_id, len({_TOK.format('text')}) AS len FROM documents)) GROUP BY batch""",
)
def _(t):
    sized = t.documents.select("doc_id", X.token_count("text").alias("len"))
    out = O.length_sorted_batches(sized, F.col("len"), [F.col("doc_id")], 32)
    return out.groupBy("batch").agg(
        F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest")
    )


@query(
    "d3_padded_batches",
    f"""WITH {_PAIRS}, b AS (SELECT *, len(ids) - 1 AS seq, (row_number() OVER (ORDER BY len(ids), conv_id, turn)
          - 1) // 8 AS batch FROM ex),
        w AS (SELECT *, max(seq) OVER (PARTITION BY batch) AS width,
          least(greatest(prompt_len - 1, 0), seq) AS hidden FROM b)
        SELECT conv_id, turn, batch, CAST(width AS INTEGER) AS width,
          array_to_string(list_concat(list_transform(range(width - seq), lambda x: {PAD}), ids[1:seq]), ' ')
            AS input_ids,
          array_to_string(list_concat(list_transform(range(width - seq + hidden), lambda x: -100),
            ids[hidden + 2:seq + 1]), ' ') AS labels,
          CAST(seq AS INTEGER) AS visible, CAST(greatest(len(ids) - prompt_len, 0) AS INTEGER) AS supervised
        FROM w""",
)
def _(t):
    ties = [F.col("conv_id"), F.col("turn")]
    batches = O.length_sorted_batches(_examples(t), F.size("token_ids"), ties, 8)
    out = O.padded_batches(batches, PAD)

    def joined(name):
        return F.array_join(F.col(name).cast("array<string>"), " ").alias(name)

    visible = F.size(F.filter("attn_mask", lambda m: m)).alias("visible")
    return out.select(
        "conv_id", "turn", "batch", "width", joined("input_ids"), joined("labels"), visible,
        "supervised",
    )


@query(
    "d4_stride_shards",
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS shard FROM documents",
)
def _(t):
    out = ordering.stride_shards(t.documents.select("doc_id"), [F.col("doc_id")], 4)
    return out.select("doc_id", "shard")


@query(
    "d5_generation_cost",
    f"""WITH {_PAIRS}, n AS (SELECT len({_TOK.format('prompt')}) AS i, len({_TOK.format('reply')}) AS o FROM pairs)
        SELECT count(*) AS examples, round(avg(i), 6) + 0.0 AS avg_in, round(avg(o), 6) + 0.0 AS avg_out,
          round((sum(i) * 0.5 + sum(o) * 2.0) / 1e6, 6) + 0.0 AS cost FROM n""",
)
def _(t):
    pairs = O.user_assistant_pairs(t.conversations)
    out = O.generation_cost(pairs, "prompt", "reply", 0.5, 2.0)
    return out.withColumns({c: round6(F.col(c)) for c in ("avg_in", "avg_out", "cost")})


@query(
    "d6_chat_prompts",
    """SELECT conv_id, CAST(0 AS BIGINT) AS part, string_agg('<|im_start|>' || role || chr(10) || text ||
         '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt
       FROM conversations GROUP BY conv_id""",
)
def _(t):
    return O.chat_prompts(t.conversations)


@query(
    "d7_repaired_history",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text
       FROM conversations WHERE trim(text) <> ''""",
)
def _(t):
    return O.repaired_history(t.conversations)


@query(
    "g5_common_prefix",
    f"""WITH k AS (SELECT conv_id, turn, {_TOK.format('text')} AS a FROM conversations),
        j AS (SELECT x.conv_id, x.turn, x.a AS a, y.a AS b FROM k x JOIN k y
          ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
        n AS (SELECT conv_id, turn, b, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1),
          lambda i: a[i] <> b[i]), true) - 1, least(len(a), len(b))) AS same FROM j)
        SELECT conv_id, turn, CAST(same AS BIGINT) AS same, b[same + 1] AS next_token FROM n""",
)
def _(t):
    toks = t.conversations.select("conv_id", "turn", X.tokens("text").alias("a"))
    nxt = toks.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return toks.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        X.common_prefix_len("a", "b").alias("same"),
        X.first_new_item("a", "b").alias("next_token"),
    )


@query(
    "x30_before_end_token",
    """WITH g AS (SELECT seq_id, pos, list(token_id ORDER BY token_id DESC) AS a FROM v_tokens GROUP BY ALL)
       SELECT seq_id, pos, array_to_string(CASE WHEN list_contains(a, 3) THEN a[1:list_position(a, 3) - 1]
         ELSE a END, ' ') AS kept FROM g""",
    ("v_tokens",),
)
def _(t):
    # One group is one position with at most five token ids.
    groups = V.v_tokens(t).groupBy("seq_id", "pos").agg(
        F.sort_array(F.collect_list("token_id"), asc=False).alias("a")
    )
    kept = X.before_first("a", 3).cast("array<string>")
    return groups.select("seq_id", "pos", F.array_join(kept, " ").alias("kept"))
