"""Streaming jobs drained to the end, and the hooks for user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.boards import ELO_SQL
from answerloom.catalog.registry import query
from answerloom.catalog.votes import _STOP
from answerloom.functions import adapters as A
from answerloom.functions.common import round6
from answerloom.functions.grading import heuristic_score
from answerloom.plans import views as V
from answerloom.plans.skew import with_group_stats
from answerloom.session import scratch_path
from answerloom.streaming import jobs as J
from answerloom.streaming import states

WAVES = 3


def _waves(df, order: str, path: str):
    """Write ``df`` as a few waves of files in ``order``, the way it would arrive."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) // WAVES + 1
    for i in range(WAVES):
        part = df.where(F.floor((F.col(order) - low) / width) == i)
        part.write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _arriving(df, order: str, base: str, run) -> None:
    """Let ``df`` arrive as a few waves in ``order``; ``run(stream)`` drains each before the next.

    A wave is one micro-batch, so their number does not grow with the table. ``df`` is worked
    out once.
    """
    df.write.parquet(f"{base}/all")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{base}/all")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        low = high = 0
    width = (high - low) // WAVES + 1
    for i in range(WAVES):
        first = low + i * width
        part = rows.where((F.col(order) >= first) & (F.col(order) < first + width))
        part.write.mode("append").parquet(f"{base}/in")
        run(df.sparkSession.readStream.schema(df.schema).parquet(f"{base}/in"))


@query(
    "st1_chunk_stream",
    """SELECT doc_id, CAST(s // 900 AS INTEGER) AS pos, substr(text, CAST(s AS BIGINT) + 1, 1000) AS chunk
       FROM (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS s FROM documents)""",
)
def _(t):
    states.use_keyed_state(t.spark)
    base = scratch_path(t.spark, "ingest")
    rows = t.documents.select("doc_id", "text")
    stream = _waves(rows, "doc_id", f"{base}/in")
    # The first table arrives a second time as one more file and must not be chunked again.
    rows.write.mode("append").parquet(f"{base}/in")
    J.drain(J.chunk_stream(stream, f"{base}/out", f"{base}/state", file="doc_id"))
    return t.spark.read.parquet(f"{base}/out").select("doc_id", "pos", "chunk")


@query(
    "st2_windowed_metrics",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST(value AS DECIMAL(18,2)))
         AS DOUBLE) / count(*), 6) + 0.0 AS mean, min(value) AS lowest, max(value) AS highest
       FROM events GROUP BY 1, 2""",
)
def _(t):
    base = scratch_path(t.spark, "metrics-stream")
    stream = _waves(t.events.select("event_id", "ts", "event_type", "value"), "event_id", f"{base}/in")
    updates = J.windowed_metrics(stream, decimals=2)
    J.drain(J.write_batches(updates, f"{base}/out", f"{base}/state", output_mode="update"))
    out = J.latest(t.spark.read.parquet(f"{base}/out"), ["window_start", "event_type"])
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n",
        F.col("total").cast("double").alias("total"), round6(F.col("mean")).alias("mean"), "lowest", "highest",
    )


@query("st3_online_elo", ELO_SQL, ("v_votes",))
def _(t):
    base = scratch_path(t.spark, "votes-stream")

    def run(stream):
        ratings = states.online_elo(stream)
        J.drain(J.write_batches(ratings, f"{base}/out", f"{base}/state", output_mode="update"))

    _arriving(V.v_votes(t), "seq", base, run)
    out = J.latest(t.spark.read.parquet(f"{base}/out"), ["arena", "model"])
    return out.select("arena", "model", round6(F.col("rating")).alias("rating"))


@query(
    "st4_online_majority",
    f"""WITH {_STOP}, n AS (SELECT item, count(*) AS n FROM v_samples GROUP BY item)
        SELECT item, CASE WHEN max(cnt) * 2 > any_value(n) THEN arg_max(answer, cnt) END AS final_answer,
          CAST(sum(cnt) AS BIGINT) AS n_used FROM uc JOIN n USING (item) GROUP BY item""",
    ("v_samples",),
)
def _(t):
    base = scratch_path(t.spark, "samples-stream")
    samples = V.v_samples(t).select("item", "sample_idx", "answer")
    sized = with_group_stats(samples, ["item"], {"num_samples": F.count("*")})

    def run(stream):
        J.drain(J.write_batches(states.online_majority(stream), f"{base}/out", f"{base}/state"))

    _arriving(sized, "sample_idx", base, run)
    return t.spark.read.parquet(f"{base}/out").drop("batch_id")


def _length_client():
    def call(prompts):
        return [f"answer {len(p)}" for p in prompts]

    return call


@query(
    "udf2_generate",
    "SELECT item_id, 'answer ' || length(text) AS generated_text FROM benchmark",
)
def _(t):
    out = A.generate(t.benchmark, "text", _length_client, concurrency=4)
    return out.select("item_id", "generated_text")


@query(
    "udf3_scorer",
    """SELECT doc_id, CAST(length(text) - length(lang) AS DOUBLE) AS score FROM documents""",
)
def _(t):
    score = A.scorer(lambda answer, prompt: answer.str.len() - prompt.str.len())
    return t.documents.select("doc_id", score("text", "lang").alias("score"))


def _shape_encoder():
    def encode(texts):
        return [[len(x), x.count(" ")] for x in texts]

    return encode


@query(
    "udf4_embedder",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS size, CAST(length(text) - length(replace(text, ' ', ''))
       AS DOUBLE) AS spaces FROM documents""",
)
def _(t):
    embed = A.embedder(_shape_encoder)
    out = t.documents.select("doc_id", embed("text").alias("v"))
    return out.select(
        "doc_id", F.get("v", F.lit(0)).cast("double").alias("size"),
        F.get("v", F.lit(1)).cast("double").alias("spaces"),
    )


@query(
    "udf1_row_predicates",
    "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1500 AND contains(p_name, 'red')",
)
def _(t):
    keep = A.all_of(
        [F.col("p_size") > 10, F.col("p_retailprice") < 1500, F.col("p_name").contains("red")]
    )
    return t.part.where(keep).select("p_partkey")


@query(
    "udf3_heuristic_best",
    r"""SELECT source, arg_max(doc_id, (round(CASE WHEN regexp_matches(text, '\d') THEN 1.0 ELSE 0.0 END
          + 1.5 * exp(-length(text) / 500.0), 9), -doc_id)) AS doc_id FROM documents GROUP BY source""",
)
def _(t):
    scored = t.documents.select("source", "doc_id", F.round(heuristic_score("text"), 9).alias("s"))
    best = F.max_by("doc_id", F.struct("s", -F.col("doc_id")))
    return scored.groupBy("source").agg(best.alias("doc_id"))
