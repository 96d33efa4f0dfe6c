"""Readers that turn mixed files into tables of text columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.common import is_blank, strict_json, strip
from answerloom.session import reliable_checkpoint
from answerloom.sources import splits
from answerloom.sources.splits import SPLIT_BYTES

# fixed values: file extension -> format
FORMATS = {
    "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "records", "ndjson": "records",
    "parquet": "parquet", "orc": "orc", "txt": "lines", "md": "lines", "log": "lines",
}
RAW_JSON, RAW_TEXT = "RawJSON", "RawText"
HEADER_SCAN_ROWS = 10
_REPLACEMENT = "�"  # what undecodable bytes become


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Pick the reader by extension; an unknown one gives a raw text row per file."""
    if fmt is None:
        tail = re.search(r"\.([A-Za-z0-9]+)(?:\.(?:gz|bz2|zst))?/*$", path)
        fmt = FORMATS.get(tail.group(1).lower(), "raw") if tail else "raw"
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, sep="\t" if fmt == "tsv" else ",", **options)
    if fmt == "json":
        return read_json_table(spark, path)
    if fmt == "records":
        return read_records(spark, path)
    if fmt == "lines":
        return spark.read.text(path).select(F.col("value").alias("text"))
    if fmt in ("parquet", "orc"):
        return spark.read.format(fmt).load(path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias(RAW_TEXT))


def _csv(spark: SparkSession, path: str, sep: str, multiline: bool, split_bytes: int) -> DataFrame:
    """CSV with a header; quoted line breaks are kept, and large files are cut by several tasks."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, **options)
    if not multiline or not splits.has_large_files(spark, path, split_bytes):
        return raw
    rows = splits.split_csv_rows(spark, path, split_bytes).where("k > 0")
    cells = ", ".join(f"c{i} string" for i in range(len(raw.columns)))
    large = rows.select(F.from_csv("record", cells, options).alias("r")).select("r.*")
    small = raw.where(F.col("_metadata.file_size") <= split_bytes)
    return small.unionAll(large.toDF(*raw.columns))


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", multiline: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Header row, UTF-8, every value a string, undecodable bytes dropped.

    Quoted line breaks need ``multiline``. Files above ``split_bytes`` are then cut into rows
    by several tasks, for which a quote sign has to belong to a quoted value; smaller ones are
    read by a task each. ``multiline=False`` leaves all to Spark's line splits.
    """
    raw = _csv(spark, path, sep, multiline, split_bytes)
    return raw.select(*[F.replace(F.col(f"`{c}`"), F.lit(_REPLACEMENT), F.lit("")).alias(c)
                        for c in raw.columns])


def read_csv_blocks(
    spark: SparkSession, path: str, multiline: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """S3: split reads; rows without any value dropped, unnamed headers called ``Column_i``."""
    raw = _csv(spark, path, ",", multiline, split_bytes)
    names = [
        f"Column_{i}" if not c.strip() or re.match(r"(Unnamed|_c\d+$)", c) else c.strip()
        for i, c in enumerate(raw.columns)
    ]
    return raw.toDF(*names).na.drop("all")


def _whole_files(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    texts = texts if only is None else texts.where(only)
    return texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _size_at_most(split_bytes: int) -> Column:
    return F.col("_metadata.file_size") <= split_bytes


class _LargeJson:
    """JSON files above a size: which of them are arrays, lines or one value, read by many tasks."""

    def __init__(self, spark: SparkSession, path: str, split_bytes: int):
        pieces = splits.scan_pieces(spark, path, "}", split_bytes)
        shapes = splits.describe_blocks(pieces, True)
        roots = splits.file_roots(shapes)
        listed = roots.where("head = '['").select("file")
        self.parts = splits.split_array_parts(pieces.join(listed, "file", "left_semi"),
                                              shapes.join(listed, "file", "left_semi"))
        self.counts = splits.array_counts(self.parts)
        broken = self.counts.where("NOT sound").select("file").distinct()
        several = roots.where("head = '{' AND values > 1").select("file")
        #: Files that are neither one array nor one object.
        self.lines = several.unionAll(broken)
        #: One value a file, or no sign of JSON: names only, read whole.
        self.single = [r.file for r in roots.where("NOT (head <=> '[') AND NOT (head <=> '{' AND values > 1)").collect()]
        self.size = F.col("_metadata.file_size") > split_bytes

    def elements(self, kind: str) -> DataFrame:
        return splits.array_elements(self.parts, self.counts, kind)

    def whole(self, more: list[str] = ()) -> Column:
        """Condition on file metadata for the files that are read whole."""
        return self.size & F.col("_metadata.file_path").isin([*self.single, *more])


def _kind(value: Column) -> Column:
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def read_json_table(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """JSON arrays of objects as rows; a file that is anything else is one raw row.

    A file's columns are the keys of its first object. Several files are put under the union
    of their columns, in order of first appearance by file, with blanks where a file lacks
    one. Only if no file is an array are there just raw rows. An array above ``split_bytes``
    is cut into its elements by several tasks; a raw row is its file's whole text anyway.
    """
    large = _LargeJson(spark, path, split_bytes) if splits.has_large_files(spark, path, split_bytes) else None
    only = None if large is None else _size_at_most(split_bytes)
    files = _whole_files(spark, path, only).withColumn("v", strict_json(F.col("text")))
    first = F.try_variant_get("v", "$[0]", "variant")
    tabular = (_kind(F.col("v")) == "ARRAY") & (_kind(first) == "OBJECT")
    tabular = F.coalesce(tabular, F.lit(False))
    keys = F.map_keys(F.try_variant_get(first, "$", "map<string,variant>"))
    heads = files.where(tabular).select("file", keys.alias("own"))
    odd = files.where(~tabular).select("text")
    rows = files.where(tabular).select(
        keys.alias("own"), F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("r")
    )
    if large is not None:
        elements = large.elements("variant")
        lead = elements.where("line_no = 1").where(_kind(F.col("record")) == "OBJECT")
        own = F.map_keys(F.try_variant_get("record", "$", "map<string,variant>"))
        lead = reliable_checkpoint(lead.select("file", own.alias("own")))
        plain = large.counts.select("file").unionAll(large.lines).distinct().join(lead, "file", "left_anti")
        heads = heads.unionAll(lead)
        rows = rows.unionAll(elements.join(lead, "file").select("own", F.col("record").alias("r")))
        raw = _whole_files(spark, path, large.whole([r.file for r in plain.collect()]))
        odd = odd.unionAll(raw.select("text"))
    named = heads.select("file", F.posexplode("own").alias("pos", "k"))
    head = named.groupBy("k").agg(F.min(F.struct("file", "pos")).alias("at")).orderBy("at").collect()
    odd = odd.select(F.col("text").alias(RAW_JSON))
    if not head:
        return odd
    rows = rows.select(
        *[
            F.coalesce(
                F.when(F.array_contains("own", r["k"]), F.try_variant_get("r", f"$['{r['k']}']", "string")),
                F.lit(""),
            ).alias(r["k"])
            for r in head
        ]
    )
    if odd.limit(1).count():
        rows = rows.unionByName(odd, allowMissingColumns=True)
    return rows


def _record_rows(files: DataFrame) -> DataFrame:
    """(file, line_no, record, bad) of whole files in any of the four root shapes."""
    v = F.col("v")
    inner = F.try_variant_get(v, "$.records", "variant")
    kind = _kind(v)
    whole = (
        F.when(kind == "ARRAY", F.try_variant_get(v, "$", "array<string>"))
        .when((kind == "OBJECT") & (_kind(inner) == "ARRAY"),
              F.try_variant_get(inner, "$", "array<string>"))
        .when(kind == "OBJECT", F.array(F.to_json(v)))
    )
    lines = F.split("text", r"\r?\n")
    staged = files.withColumn("v", strict_json(F.col("text"))).withColumn(
        "rows", F.coalesce(whole, F.when(v.isNull(), lines))
    )
    # ``bad`` repeats the row's own condition: a check on it may run before the filter does.
    lone = v.isNotNull() & F.col("rows").isNull()
    scalar = staged.where(lone).select(
        "file", F.lit(0).alias("line_no"), F.col("text").alias("record"), lone.alias("bad")
    )
    rows = staged.where(F.col("rows").isNotNull()).select(
        "file", v.isNull().alias("__lines"), F.posexplode("rows").alias("pos", "record")
    )
    used = ~F.col("__lines") | ~is_blank(F.col("record"))
    checked = rows.where(used).select(
        "file",
        (F.col("pos") + 1).alias("line_no"),
        "record",
        (used & strict_json(F.col("record")).isNull()).alias("bad"),
    )
    return checked.unionByName(scalar)


def _large_record_rows(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """(file, line_no, record, bad) of files above a size: arrays and lines by several tasks."""
    large = _LargeJson(spark, path, split_bytes)
    lines = splits.split_lines(spark, path, split_bytes).join(large.lines, "file", "left_semi")
    lines = lines.withColumnRenamed("line", "record").where(~is_blank(F.col("record")))
    rows = large.elements("string").unionAll(lines)
    rows = rows.withColumn("bad", strict_json(F.col("record")).isNull())
    return rows.unionByName(_record_rows(_whole_files(spark, path, large.whole())))


def read_records(
    spark: SparkSession,
    path: str,
    quarantine: bool = False,
    json_lines: bool | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Records from an array, ``{"records": [...]}``, one object, or JSON lines.

    Gives ``(file, line_no, record)`` with the record as JSON text. A bad line stops the
    job with its file and line number, or with ``quarantine`` stays as a row with
    ``bad = true``. ``json_lines`` promises one record per line, which lets Spark split a
    file; line numbers are then NULL. Without that promise, arrays and JSON lines in files
    above ``split_bytes`` are cut by several tasks; one object a file is read whole.
    """
    if json_lines:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.lit(None).cast("int").alias("line_no"),
            F.col("value").alias("record"),
        )
        used = ~is_blank(F.col("record"))
        rows = lines.where(used).withColumn("bad", used & strict_json(F.col("record")).isNull())
    elif splits.has_large_files(spark, path, split_bytes):
        rows = _record_rows(_whole_files(spark, path, _size_at_most(split_bytes)))
        rows = rows.unionByName(_large_record_rows(spark, path, split_bytes))
    else:
        rows = _record_rows(_whole_files(spark, path))
    if quarantine:
        return rows
    where = F.concat(
        F.lit("invalid JSON on line "), F.coalesce(F.col("line_no").cast("string"), F.lit("?")),
        F.lit(" in "), F.col("file"),
    )
    sound = F.when(~F.col("bad"), True).otherwise(F.raise_error(where).cast("boolean"))
    return rows.where(sound).select("file", "line_no", "record")


def record_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Named text fields of the records; a missing field stops the job."""
    v = F.try_parse_json("record")
    values = {name: F.try_variant_get(v, f"$['{name}']", "string") for name in fields}
    sound = F.lit(True)
    for name, value in values.items():
        missing = F.raise_error(F.lit(f"missing key: {name}")).cast("boolean")
        sound = sound & F.when(value.isNotNull(), True).otherwise(missing)
    return records.where(sound).select("file", "line_no", *[c.alias(n) for n, c in values.items()])


def numbered_lines(df: DataFrame, key: str, text: str, drop_blank: bool = False) -> DataFrame:
    """One row per line with its 1-based number; optionally trimmed, without blank lines."""
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    lines = df.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("n", "line"))
    lines = lines.select(key, (F.col("n") + 1).alias("line_no"), "line")
    if not drop_blank:
        return lines
    return lines.where(~is_blank(F.col("line"))).withColumn("line", strip(F.col("line")))


def read_lines(
    spark: SparkSession, path: str, drop_blank: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """S6 from files; those above ``split_bytes`` are numbered over several tasks."""
    if not splits.has_large_files(spark, path, split_bytes):
        return numbered_lines(_whole_files(spark, path), "file", "text", drop_blank)
    small = _whole_files(spark, path, _size_at_most(split_bytes))
    rows = numbered_lines(small, "file", "text", drop_blank)
    large = splits.split_lines(spark, path, split_bytes)
    if drop_blank:
        large = large.where(~is_blank(F.col("line"))).withColumn("line", strip(F.col("line")))
    return rows.unionAll(large)


def paragraphs(df: DataFrame, key: str, text: str, separator: str = r"\n\n") -> DataFrame:
    """Page or paragraph rows with blanks dropped; numbers keep the original place."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), separator)).alias("n", "Text"))
    kept = rows.where(~is_blank(F.col("Text")))
    return kept.select(key, (F.col("n") + 1).alias("Page"), strip(F.col("Text")).alias("Text"))


def rows_below_header(lines: DataFrame, file: str = "file", scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """Rows under each file's header as ``(file, line_no, row MAP<STRING,STRING>)``.

    The header is the first of the first ten lines with two or more non-blank cells. Blank
    header cells are called ``Column{j}``; a leading placeholder column and all-blank rows
    are dropped.
    """
    filled = F.size(F.filter("cells", lambda c: ~is_blank(c)))
    candidates = lines.where((F.col("line_no") <= scan) & (filled >= 2))
    found = candidates.groupBy(file).agg(
        F.min("line_no").alias("__at"), F.min_by("cells", "line_no").alias("__head")
    )
    named = F.transform(
        "__head",
        lambda c, j: F.when(is_blank(c), F.concat(F.lit("Column"), j.cast("string"))).otherwise(strip(c)),
    )
    found = found.withColumn("__head", named)
    body = lines.join(found, file).where((F.col("line_no") > F.col("__at")) & (filled > 0))
    skip = F.when(F.get("__head", F.lit(0)).startswith("Column"), 1).otherwise(0)
    staged = body.withColumn("__skip", skip)
    width = F.size("__head") - F.col("__skip")
    head = F.slice("__head", F.col("__skip") + 1, width)
    cells = F.slice("cells", F.col("__skip") + 1, width)
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.coalesce(F.get(cells, j), F.lit("")))
    return staged.select(file, "line_no", F.map_from_arrays(head, padded).alias("row"))


def read_metric_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric CSV with or without header; empty optional cells are NULL.

    Columns are read by name when a header is present, else by the order of ``schema``.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = dict(part.strip().split(" ", 1) for part in schema.split(","))
    head = spark.read.text(path).first()
    present = [c.strip() for c in head[0].split(",")] if head else []
    labelled = names[0] in present
    order = present if labelled else names
    raw = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in order), nullValue="")
    rows = raw.where(~F.col(f"`{names[0]}`").eqNullSafe(names[0])) if labelled else raw
    return rows.select(
        *[
            (F.col(f"`{n}`") if n in order else F.lit(None)).try_cast(kinds[n]).alias(n)
            for n in names
        ]
    )
