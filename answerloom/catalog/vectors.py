"""Vector search over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.functions.common import round6
from answerloom.operators import filters as R
from answerloom.operators import vectors as O
from answerloom.session import scratch_path

DIM = 64

_CENTROIDS = """u AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings),
  m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
  cent AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)"""
_NEAR = """d AS (SELECT cent.label AS query_id, vec_id,
    list_distance(embedding::DOUBLE[], c) ** 2 AS distance FROM embeddings, cent),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)"""


def _centroids(t):
    return O.mean_pool(t.embeddings, ["label"], "embedding", DIM)


def _hits(t, k):
    queries = _centroids(t).withColumnRenamed("label", "query_id")
    return O.nearest(t.embeddings, queries, k)


@query(
    "v1_nearest",
    f"""WITH {_CENTROIDS}, {_NEAR} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank,
        round(distance, 6) + 0.0 AS distance FROM near WHERE rank <= 5""",
)
def _(t):
    return _hits(t, 5).withColumn("distance", round6(F.col("distance")))


@query(
    "v1_nearest_native",
    f"""WITH {_CENTROIDS}, d AS (SELECT vec_id, list_distance(embedding::DOUBLE[],
          (SELECT list(x ORDER BY i) FROM (SELECT i, avg(x) AS x FROM u GROUP BY i))) ** 2 AS distance FROM embeddings)
        SELECT vec_id, round(distance, 6) + 0.0 AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10""",
)
def _(t):
    everything = O.mean_pool(t.embeddings.withColumn("all", F.lit(0)), ["all"], "embedding", DIM)
    centre = everything.first()["embedding"]  # one vector
    top = O.nearest_to_one(t.embeddings, centre, 10)
    return top.withColumn("distance", round6(F.col("distance")))


@query("v2_add_vectors", "SELECT vec_id, label FROM embeddings")
def _(t):
    path = scratch_path(t.spark, "vectors")
    rows = t.embeddings
    first = O.add_vectors(None, rows.where(F.col("label") > 3))
    first.write.partitionBy("label").parquet(path)
    stored = t.spark.read.parquet(path)
    O.add_vectors(stored, rows).write.mode("append").partitionBy("label").parquet(path)
    return t.spark.read.parquet(path).select("vec_id", "label")


@query(
    "v3_mean_pool",
    f"WITH {_CENTROIDS} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM m",
)
def _(t):
    out = _centroids(t).select("label", F.posexplode("embedding").alias("i", "x"))
    return out.withColumn("x", round6(F.col("x")))


@query(
    "v4_cosine",
    f"""WITH {_CENTROIDS} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) + 0.0 AS score
        FROM embeddings JOIN cent USING (label)""",
)
def _(t):
    own = _centroids(t).withColumnRenamed("embedding", "centre")
    rows = t.embeddings.join(own, "label")
    return rows.select("vec_id", round6(O.cosine("embedding", "centre")).alias("score"))


@query(
    "v5_nearest_prototype",
    f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, cent.label AS predicted,
          list_cosine_similarity(embedding::DOUBLE[], c) AS similarity FROM embeddings, cent)
        SELECT vec_id, predicted, round(similarity, 6) + 0.0 AS similarity FROM s
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, predicted) = 1""",
)
def _(t):
    out = O.nearest_prototype(t.embeddings, _centroids(t))
    return out.withColumn("similarity", round6(F.col("similarity")))


@query(
    "j4_hit_payload",
    f"""WITH {_CENTROIDS}, {_NEAR} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, lang, source
        FROM near JOIN documents ON doc_id = vec_id WHERE rank <= 5""",
)
def _(t):
    payload = t.documents.select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return O.hit_payload(_hits(t, 5).drop("distance"), payload, "vec_id")


@query(
    "v7_context",
    f"""WITH {_CENTROIDS}, {_NEAR} SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context
        FROM near JOIN documents ON doc_id = vec_id WHERE rank <= 3 GROUP BY query_id""",
)
def _(t):
    payload = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    return O.context(_hits(t, 3), payload, "vec_id", "query_id", "text")


_SEMANTIC = f"""WITH {_CENTROIDS}, {_NEAR}, sem AS (SELECT vec_id, label, 'semantic' AS source FROM near
    JOIN embeddings USING (vec_id) WHERE rank <= 5 AND query_id = (SELECT min(label) FROM embeddings)),
  st AS (SELECT vec_id, label, 'structured' AS source FROM embeddings WHERE {{}} ORDER BY vec_id LIMIT 5)
  SELECT * FROM st UNION ALL SELECT * FROM sem WHERE NOT EXISTS (SELECT 1 FROM st)"""


def _hybrid(t, predicate):
    low = t.embeddings.agg(F.min("label")).scalar()
    hits = _hits(t, 5).where(F.col("query_id") == low).select("vec_id")
    fallback = t.embeddings.join(F.broadcast(hits), "vec_id").select("vec_id", "label")
    rows = t.embeddings.select("vec_id", "label")
    return R.structured_or_fallback(rows, predicate, ["vec_id"], 5, fallback)


@query("f5_hybrid_structured", _SEMANTIC.format("label % 2 = 1 AND vec_id > 10"))
def _(t):
    return _hybrid(t, (F.col("label") % 2 == 1) & (F.col("vec_id") > 10))


@query("v6_hybrid_semantic", _SEMANTIC.format("label < 0"))
def _(t):
    return _hybrid(t, F.col("label") < 0)
