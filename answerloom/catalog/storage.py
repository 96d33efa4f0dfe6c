"""Round trips through readers, sinks and the file store, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.catalog.registry import query
from answerloom.operators import evaluate as E
from answerloom.operators.ordering import row_blocks
from answerloom.plans import views as V
from answerloom.plans.skew import group_positions
from answerloom.session import scratch_path
from answerloom.sources import readers as R
from answerloom.sources import store as S

_FORMATS = ["csv", "json", "parquet", "orc"]


def _json_arrays(df, order, size=500):
    """The rows of ``df`` as JSON array texts, one per block of ``size`` rows."""
    blocks = row_blocks(df, order, size)
    row = F.struct(*df.columns)
    return blocks.groupBy("block").agg(F.to_json(F.collect_list(row)).alias("value"))


@query(
    "s1_read_any",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS fmt, CAST(event_id AS VARCHAR) AS event_id, event_type FROM events"""
        for f in _FORMATS
    )
    + " UNION ALL SELECT 'txt', CAST(event_id AS VARCHAR), event_type FROM events",
)
def _(t):
    base = scratch_path(t.spark, "any")
    rows = t.events.select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    rows.write.option("header", True).csv(f"{base}/events.csv")
    rows.write.parquet(f"{base}/events.parquet")
    rows.write.orc(f"{base}/events.orc")
    arrays = _json_arrays(rows, [F.col("event_id")], 5000).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(f"{base}/events.json")
    lines = rows.select(F.concat_ws("|", "event_id", "event_type").alias("value"))
    lines.write.text(f"{base}/events.txt")
    text = R.read_any(t.spark, f"{base}/events.txt").select(
        F.lit("txt").alias("fmt"),
        F.substring_index("text", "|", 1).alias("event_id"),
        F.substring_index("text", "|", -1).alias("event_type"),
    )
    for fmt in _FORMATS:
        part = R.read_any(t.spark, f"{base}/events.{fmt}")
        text = text.unionByName(part.select(F.lit(fmt).alias("fmt"), "event_id", "event_type"))
    return text


@query(
    "s2_csv_text",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "x"' || chr(10) || 'é' AS label,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "csv")
    label = F.concat("c_name", F.lit(', "x"\né')).alias("label")
    rows = t.customer.select("c_custkey", label, "c_nationkey")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return R.read_csv(t.spark, path)


@query(
    "s3_csv_blocks",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS "Column_1" FROM customer WHERE c_custkey % 6 <> 5""",
)
def _(t):
    path = scratch_path(t.spark, "blocks")
    keep = F.col("c_custkey") % 6 != 5
    rows = t.customer.select(
        F.when(keep, F.col("c_custkey")).alias("key"),
        F.when(keep, F.col("c_mktsegment")).alias("Unnamed: 1"),
    )
    rows.write.option("header", True).csv(path)
    return R.read_csv_blocks(t.spark, path)


@query(
    "s4_json_table",
    """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey
       FROM supplier""",
)
def _(t):
    path = scratch_path(t.spark, "json")
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    arrays = _json_arrays(rows, [F.col("s_suppkey")], 50).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return R.read_json_table(t.spark, path)


@query("s5_records", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def _(t):
    path = scratch_path(t.spark, "records")
    rows = t.part.select("p_partkey", "p_name")
    blocks = row_blocks(rows, [F.col("p_partkey")], 200)
    item = F.collect_list(F.to_json(F.struct("p_partkey", "p_name")))
    shape = F.col("block") % 3
    joined = F.array_join("items", ", ")
    texts = blocks.groupBy("block").agg(item.alias("items")).select(
        F.when(shape == 0, F.concat(F.lit("["), joined, F.lit("]")))
        .when(shape == 1, F.concat(F.lit('{"records": ['), joined, F.lit("]}")))
        .otherwise(F.array_join("items", "\n\n"))
        .alias("value")
    )
    texts.write.option("maxRecordsPerFile", 1).text(path)
    records = R.read_records(t.spark, path)
    return R.record_fields(records, ["p_partkey", "p_name"]).select("p_partkey", "p_name")


@query(
    "s6_numbered_lines",
    r"""SELECT doc_id, CAST(n AS INTEGER) AS line_no, trim(line) AS line FROM (
          SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS n FROM (
            SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r?\n\z', ''), '\r?\n') AS a FROM documents))
        WHERE trim(line) <> ''""",
)
def _(t):
    return R.numbered_lines(t.documents, "doc_id", "text", drop_blank=True)


@query(
    "s7_paragraphs",
    r"""SELECT doc_id, CAST(n AS INTEGER) AS "Page", trim(x) AS "Text" FROM (
          SELECT doc_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS n FROM (
            SELECT doc_id, string_split(text, '. ') AS a FROM documents)) WHERE trim(x) <> ''""",
)
def _(t):
    return R.paragraphs(t.documents, "doc_id", "text", r"\. ")


@query(
    "s8_rows_below_header",
    """SELECT c_nationkey AS file, c_custkey || '' AS key, c_name AS name FROM customer""",
)
def _(t):
    # Three lines in front of each file's rows: a title, a blank line, the header.
    files = t.customer.select(F.col("c_nationkey").alias("file")).distinct()
    front = files.select(
        "file",
        F.inline(
            F.array(
                F.struct(F.lit(-3).cast("long").alias("at"),
                         F.array(F.lit("Report"), F.lit(""), F.lit(" ")).alias("cells")),
                F.struct(F.lit(-2).cast("long").alias("at"),
                         F.array(F.lit(""), F.lit(""), F.lit("")).alias("cells")),
                F.struct(F.lit(-1).cast("long").alias("at"),
                         F.array(F.lit(""), F.lit("Key "), F.lit("Name")).alias("cells")),
            )
        ),
    )
    body = t.customer.select(
        F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("at"),
        F.array(F.lit("x"), F.col("c_custkey").cast("string"), "c_name").alias("cells"),
    )
    placed = group_positions(front.unionByName(body), ["file"], [F.col("at")], "n")
    lines = placed.select("file", (F.col("n") + 1).cast("int").alias("line_no"), "cells")
    rows = R.rows_below_header(lines)
    return rows.select(
        "file", F.col("row")["Key"].alias("key"), F.col("row")["Name"].alias("name")
    )


@query(
    "s9_sanitized",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status FROM orders""",
)
def _(t):
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status")
    return S.sanitized(t.orders.select("o_orderkey", "o_orderdate", status))


def _stored(t):
    path = scratch_path(t.spark, "store")
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    S.append_chunks(S.file_chunks(rows, "t1", "customers.csv", [F.col("c_custkey")]), path)
    firms = t.supplier.select("s_suppkey", "s_name")
    S.append_chunks(S.file_chunks(firms, "t1", "suppliers.csv", [F.col("s_suppkey")]), path)
    S.append_chunks(S.file_chunks(firms, "t2", "suppliers.csv", [F.col("s_suppkey")]), path)
    S.append_chunks(S.text_chunk_rows(t.benchmark, "t2", "item_id", "text"), path)
    return path


@query(
    "s10_file_chunks",
    """SELECT CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS BIGINT) AS chunk,
       CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer""",
)
def _(t):
    rows = S.read_file(t.spark, _stored(t), "t1", "customers.csv")
    columns = [F.col("row")[c].alias(c) for c in ("c_custkey", "c_name", "c_mktsegment")]
    return rows.select("chunk", *columns)


@query("s11_row_log", "SELECT 'part.csv' AS source_file, p_partkey, p_name FROM part")
def _(t):
    path = scratch_path(t.spark, "row-log")
    S.append_row_log(t.part.select("p_partkey", "p_name"), path, "part.csv")
    log = t.spark.read.parquet(path)
    row = F.from_json("row_data", "p_partkey bigint, p_name string").alias("r")
    return log.select("source_file", row).select("source_file", "r.*")


@query(
    "s12_read_back",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier",
)
def _(t):
    rows = S.read_file(t.spark, _stored(t), "t2", "suppliers.csv")
    return S.rows_as_columns(rows, ["s_suppkey", "s_name"])


@query(
    "s13_stored_files",
    """SELECT 't1' AS thread_id, 'customers.csv' AS file_name, 'c_custkey,c_name,c_mktsegment' AS headers,
         count(*) AS row_count, CAST(0 AS BIGINT) AS text_length FROM customer
       UNION ALL SELECT th, 'suppliers.csv', 's_suppkey,s_name', count(*), 0 FROM supplier,
         (VALUES ('t1'), ('t2')) v(th) GROUP BY th
       UNION ALL SELECT 't2', '' || item_id, '', 0, length(text) FROM benchmark""",
)
def _(t):
    out = S.stored_files(t.spark, _stored(t))
    return out.withColumn("headers", F.array_join("headers", ","))


@query(
    "s14_delete_file",
    """SELECT 't2' AS thread_id, 'suppliers.csv' AS file_name, count(*) AS row_count FROM supplier
       UNION ALL SELECT 't1', 'customers.csv', count(*) FROM customer
       UNION ALL SELECT 't2', '' || item_id, 0 FROM benchmark
       UNION ALL SELECT thread_id, 'vectors of ' || file_name, count(*) FROM (
         SELECT 't' || (label % 2 + 1) AS thread_id,
           CASE WHEN vec_id % 3 = 0 THEN 'suppliers.csv' ELSE 'customers.csv' END AS file_name FROM embeddings)
       WHERE NOT (thread_id = 't1' AND file_name = 'suppliers.csv') GROUP BY ALL""",
)
def _(t):
    path, vectors = _stored(t), scratch_path(t.spark, "file-vectors")
    thread = F.concat(F.lit("t"), (F.col("label") % 2 + 1).cast("string"))
    name = F.when(F.col("vec_id") % 3 == 0, "suppliers.csv").otherwise("customers.csv")
    rows = t.embeddings.select("vec_id", "embedding", thread.alias("thread_id"), name.alias("file_name"))
    rows.write.partitionBy("thread_id").parquet(vectors)
    S.delete_file(t.spark, [path, vectors], "t1", "suppliers.csv")
    left = S.read_store(t.spark, vectors).groupBy("thread_id", "file_name").agg(F.count("*").alias("row_count"))
    left = left.withColumn("file_name", F.concat(F.lit("vectors of "), "file_name"))
    return S.stored_files(t.spark, path).select("thread_id", "file_name", "row_count").unionByName(left)


@query(
    "s15_evaluation_log",
    """SELECT index, 'é ' || subset AS problem, gtruth_answer, generated_text, lk % 6 NOT IN (3, 4) AS correct
       FROM v_answers""",
    ("v_answers",),
)
def _(t):
    path = scratch_path(t.spark, "evaluation")
    graded = E.graded(V.v_answers(t), "generated_text", "gtruth_answer")
    rows = graded.withColumn("problem", F.concat(F.lit("é "), "subset"))
    log = E.evaluation_records(rows, "index", "problem", "gtruth_answer", "generated_text")
    S.write_evaluation_log(log, path)
    schema = log.schema
    return t.spark.read.schema(schema).json(path).drop("extracted")


_METRICS = "epoch int, total_steps bigint, train_loss double, val_loss double"


@query(
    "s16_metric_log",
    """SELECT epoch, total_steps, round(train_loss, 8) + 0.0 AS train_loss,
       round(val_loss, 8) + 0.0 AS val_loss FROM v_metrics""",
    ("v_metrics",),
)
def _(t):
    path = scratch_path(t.spark, "metrics")
    rows = V.v_metrics(t)
    S.append_metrics(rows.where(F.col("epoch") <= 1996), path, 9)
    S.append_metrics(rows.where(F.col("epoch") > 1996), path, 9)
    out = t.spark.read.csv(path, header=True, schema=_METRICS)
    return out.withColumns({c: F.round(c, 8) for c in ("train_loss", "val_loss")})


@query("s17_replace_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    path = scratch_path(t.spark, "swap")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    S.replace_table(rows.where(F.col("o_orderstatus") == "F"), path)
    S.replace_table(rows, path)
    return S.read_table(t.spark, path)


@query(
    "s18_read_metric_log",
    """SELECT total_steps AS step, round(train_loss, 8) + 0.0 AS loss,
       CASE WHEN epoch <= 1996 THEN round(val_loss, 8) + 0.0 END AS eval_acc FROM v_metrics""",
    ("v_metrics",),
)
def _(t):
    path = scratch_path(t.spark, "metric-log")
    rows = V.v_metrics(t).select(
        F.col("total_steps").alias("step"),
        F.col("train_loss").alias("loss"),
        F.when(F.col("epoch") <= 1996, F.col("val_loss")).alias("eval_acc"),
    )
    rows.write.option("header", True).csv(path)
    out = R.read_metric_log(t.spark, path, "step bigint, loss double, eval_acc double")
    return out.withColumns({c: F.round(c, 8) for c in ("loss", "eval_acc")})
