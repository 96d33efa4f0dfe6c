"""Sinks and the chunked file store."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.operators.ordering import row_blocks

CHUNK_ROWS = 500
#: Folders of a table's versions and of the marks that publish them; plain readers skip both.
VERSION, PUBLISHED = "_version-", "_published"


def sanitized(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, NULL as '', everything else as text."""

    def cell(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(value, "SSSSSS")
            value = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
        else:
            value = value.cast("string")
        return F.coalesce(value, F.lit("")).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def file_chunks(
    df: DataFrame, thread_id: str, file_name: str, order: Sequence[Column], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The rows as JSON arrays of at most ``chunk_rows`` rows, with the header list."""
    names = df.columns
    blocks = row_blocks(df, order, chunk_rows)
    row = F.struct("pos", F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    chunks = blocks.groupBy(F.col("block").alias("chunk")).agg(
        F.to_json(ordered, {"ignoreNullFields": "false"}).alias("rows"),
        F.count("*").alias("n_rows"),
    )
    return chunks.select(
        F.lit(thread_id).alias("thread_id"),
        F.lit(file_name).alias("file_name"),
        F.array(*[F.lit(c) for c in names]).alias("headers"),
        "chunk", "rows", "n_rows",
        F.lit(None).cast("string").alias("text_content"),
    )


def text_chunk_rows(df: DataFrame, thread_id: str, file: str, text: str) -> DataFrame:
    """The store layout of a text file: no rows, the text as it is."""
    return df.select(
        F.lit(thread_id).alias("thread_id"), F.col(file).cast("string").alias("file_name"),
        F.array().cast("array<string>").alias("headers"), F.lit(0).cast("long").alias("chunk"),
        F.lit("[]").alias("rows"), F.lit(0).cast("long").alias("n_rows"),
        F.col(text).alias("text_content"),
    )


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Add chunks to the store; a thread that was rewritten gets them in its current version.

    Appending to a thread while a file of it is deleted is the caller's to avoid.
    """
    rewritten = _current_folders(chunks.sparkSession, path)
    if rewritten:
        mine = chunks.where(F.col("thread_id").isin([*rewritten])).select("thread_id").distinct()
        for thread in [r.thread_id for r in mine.collect()]:
            own = chunks.where(F.col("thread_id") == thread).drop("thread_id")
            own.write.mode("append").parquet(rewritten[thread])
        chunks = chunks.where(~F.col("thread_id").isin([*rewritten]))
    chunks.write.mode("append").partitionBy("thread_id").parquet(path)


def read_store(spark: SparkSession, path: str, thread_id: str | None = None) -> DataFrame:
    """The current chunks of a table laid out by thread, without what was deleted.

    Folder names only are listed, as Spark does to find partitions.
    """
    rewritten = _current_folders(spark, path)
    if not rewritten:
        stored = spark.read.parquet(path)
    else:
        fs, folders = _file_system(spark, f"{path}/thread_id=*")
        plain = {f.getPath().getName(): f.getPath().toString() for f in fs.globStatus(folders)}
        current = {f"thread_id={_folder_name(t)}": folder for t, folder in rewritten.items()}
        stored = spark.read.option("basePath", path).parquet(*{**plain, **current}.values())
    return stored if thread_id is None else stored.where(F.col("thread_id") == thread_id)


def read_file(spark: SparkSession, path: str, thread_id: str, file_name: str) -> DataFrame:
    """Rows of one stored file as ``(chunk, row MAP)``; only its thread's partition is read."""
    stored = read_store(spark, path, thread_id).where(F.col("file_name") == file_name)
    rows = F.from_json("rows", "array<map<string,string>>")
    return stored.select("chunk", "headers", F.explode(rows).alias("row"))


def rows_as_columns(rows: DataFrame, headers: Sequence[str]) -> DataFrame:
    return rows.select(*[F.try_element_at("row", F.lit(h)).alias(h) for h in headers])


def stored_files(spark: SparkSession, path: str, thread_id: str | None = None) -> DataFrame:
    """Files with headers, row count and text length; the JSON payload is not read."""
    return read_store(spark, path, thread_id).groupBy("thread_id", "file_name").agg(
        F.any_value("headers").alias("headers"),
        F.sum("n_rows").alias("row_count"),
        F.coalesce(F.sum(F.length("text_content")), F.lit(0)).alias("text_length"),
    )


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


# fixed values: signs that Spark writes as %XX in the names of partition folders
_ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\{\[\]^\x7f]"""


def _folder_name(value: str) -> str:
    """The value as Spark writes it into a partition folder's name."""
    return re.sub(_ESCAPED, lambda sign: f"%{ord(sign[0]):02X}", value)


def _versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """Highest published version and highest version begun; 0 where there is none."""
    highest = []
    for pattern in (f"{path}/{PUBLISHED}/*", f"{path}/{VERSION}*"):
        fs, found = _file_system(spark, pattern)
        names = [f.getPath().getName() for f in fs.globStatus(found) or []]
        highest.append(max((int(name.removeprefix(VERSION)) for name in names), default=0))
    return highest[0], max(highest)


def _version_folder(path: str, number: int) -> str:
    return f"{path}/{VERSION}{number:012d}"


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write a new version beside the old ones, then publish it by one empty file.

    Nothing is renamed or deleted, so ``read_table`` finds a whole set at any time, on object
    stores too, and a job that reads an older version can finish. A writer that dies leaves an
    unpublished version, which no reader sees; two writers that choose the same number
    fail instead of mixing. Gives the number of the version.
    """
    spark = df.sparkSession
    number = _versions(spark, path)[1] + 1
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(_version_folder(path, number))
    fs, mark = _file_system(spark, f"{path}/{PUBLISHED}/{number:012d}")
    fs.create(mark, False).close()
    return number


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version; a folder without versions is read as it is."""
    number = _versions(spark, path)[0]
    return spark.read.parquet(_version_folder(path, number) if number else path)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Free the space of all but the newest published versions, when no job reads them any more."""
    newest = _versions(spark, path)[0]
    fs, found = _file_system(spark, f"{path}/{VERSION}*")
    for status in fs.globStatus(found) or []:
        if int(status.getPath().getName().removeprefix(VERSION)) <= newest - max(keep, 1):
            fs.delete(status.getPath(), True)


def _current_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The newest published folder of each thread that was rewritten, by thread id."""
    fs, found = _file_system(spark, f"{path}/thread_id=*/{PUBLISHED}/*")
    newest: dict[str, int] = {}
    parts: dict[str, str] = {}
    for status in fs.globStatus(found) or []:
        part = status.getPath().getParent().getParent()
        thread = unquote(part.getName().removeprefix("thread_id="))
        newest[thread] = max(newest.get(thread, 0), int(status.getPath().getName()))
        parts[thread] = part.toString()
    return {thread: _version_folder(parts[thread], number) for thread, number in newest.items()}


def delete_file(spark: SparkSession, paths: Sequence[str], thread_id: str, file_name: str) -> None:
    """Drop a file from the store and from the vector table; other threads are not rewritten.

    A thread without files left keeps an empty version. ``read_store`` leaves deleted rows
    out at once; ``drop_deleted`` frees their space.
    """
    for path in paths:
        part = f"{path}/thread_id={_folder_name(thread_id)}"
        fs, target = _file_system(spark, part)
        if fs.exists(target):
            replace_table(read_table(spark, part).where(~F.col("file_name").eqNullSafe(file_name)), part)


def drop_deleted(spark: SparkSession, path: str) -> None:
    """Remove the replaced rows of rewritten threads for good, when no job reads them any more."""
    for folder in _current_folders(spark, path).values():
        part = folder.rsplit("/", 1)[0]
        drop_old_versions(spark, part, keep=1)
        fs, found = _file_system(spark, f"{part}/*.parquet")
        for status in fs.globStatus(found) or []:
            fs.delete(status.getPath(), False)


def append_row_log(df: DataFrame, path: str, source: str | Column) -> None:
    """One JSON object per row without its NULL fields, tagged with the source file."""
    tag = F.lit(source) if isinstance(source, str) else source
    log = df.select(
        tag.alias("source_file"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row_data")
    )
    log.write.mode("append").parquet(path)


def write_evaluation_log(df: DataFrame, path: str) -> None:
    """One JSON object per line; non-ASCII text is kept, NULL fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_metrics(df: DataFrame, path: str, digits: int = 6) -> None:
    """Append a metric log as CSV; every file carries the header line once."""
    cells = [
        F.format_string(f"%.{digits}f", F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cells).write.mode("append").option("header", True).csv(path)
