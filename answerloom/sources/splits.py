"""Records of one large file, cut by many tasks: lines, quoted CSV rows, JSON array elements.

Spark cuts a file into byte ranges and each range into pieces that end with a separator.
Whether a piece starts inside a string, and how deep it is nested, depends on all pieces
before it in the file. So each range is first described for both states it may start in
(strings open or not), the descriptions of a file are composed in order, and only then are
its records cut. One row a range, or few, meets the other ranges; the texts are exchanged
by range and by record, never by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.functions.common import is_blank, strict_json
from answerloom.session import reliable_checkpoint

#: Files above this size are cut by several tasks.
SPLIT_BYTES = 64 << 20
#: Consecutive records that are numbered by one task.
BUCKET_RECORDS = 16384


def has_large_files(spark: SparkSession, path: str, split_bytes: int) -> bool:
    """Whether any file is above the size; only file names and sizes are looked at."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > split_bytes)
    return files.select("length").limit(1).count() > 0


def scan_pieces(spark: SparkSession, path: str, sep: str, split_bytes: int) -> DataFrame:
    """``(file, size, block, seq, piece)`` of files above ``split_bytes``; ``seq`` orders a block."""
    pieces = spark.read.text(path, lineSep=sep).where(F.col("_metadata.file_size") > split_bytes)
    return pieces.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("piece"),
    )


def split_lines(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """``(file, line_no, line)`` of large files; a line travels nowhere.

    Line numbers are the place in the byte range plus the lines of earlier ranges. A carriage
    return at the end of a line goes with the line break.
    """
    lines = scan_pieces(spark, path, "\n", split_bytes)
    blocks = lines.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    line_no = F.col("seq") - F.col("first") + F.col("before") + 1
    return lines.join(blocks, ["file", "block"]).select(
        "file", line_no.cast("int").alias("line_no"), F.regexp_replace("piece", r"\r\z", "").alias("line")
    )


def _net(text: Column) -> Column:
    """Opening brackets less closing ones."""
    up, down = (F.length(F.regexp_replace(text, other, "")) for other in (r"[^\[{]", r"[^\]}]"))
    return up - down


def _described(pieces: DataFrame, nested: bool) -> DataFrame:
    """Pieces with ``q`` (quotes) and the state and depth after them for both starts of the block.

    ``end0`` and ``r0`` hold if the block starts outside a string, ``end1`` and ``r1`` inside.
    """
    plain = F.regexp_replace("piece", r"(?s)\\.", "") if nested else F.col("piece")
    staged = pieces.withColumn("plain", plain)
    staged = staged.withColumn("q", F.length(F.regexp_replace("plain", '[^"]', "")) % 2)
    if nested:
        string = r'"[^"]*("|\z)'
        rest = F.regexp_replace("plain", r'\A[^"]*("|\z)', "")
        # The separator is a closing bracket unless it lies in a string.
        staged = staged.withColumn(
            "net_out", _net(F.regexp_replace("plain", string, "")) - F.when(F.col("q") == 0, 1).otherwise(0)
        ).withColumn("net_in", _net(F.regexp_replace(rest, string, "")) - F.col("q"))
    else:
        staged = staged.withColumn("net_out", F.lit(0)).withColumn("net_in", F.lit(0))
    order = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    staged = staged.drop("plain").withColumn("end0", F.sum("q").over(order) % 2)
    outside = (F.col("end0") + F.col("q")) % 2 == 0
    staged = staged.withColumn("net0", F.when(outside, F.col("net_out")).otherwise(F.col("net_in")))
    staged = staged.withColumn("net1", F.when(outside, F.col("net_in")).otherwise(F.col("net_out")))
    return staged.select(
        *pieces.columns,
        "q",
        "end0",
        (1 - F.col("end0")).alias("end1"),
        F.sum("net0").over(order).alias("r0"),
        F.sum("net1").over(order).alias("r1"),
        "net0",
        "net1",
    )


def describe_blocks(pieces: DataFrame, nested: bool) -> DataFrame:
    """Few rows a block, one for each state and depth that its pieces end at; written once."""
    described = _described(pieces, nested)
    shapes = described.groupBy("file", "block", "end0", "r0", "r1").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("q", "net0", "net1")],
        F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size"),
        F.min("seq").alias("first"), F.min_by(F.left(F.ltrim(_unbroken("piece")), F.lit(1)), "seq").alias("head"),
    )
    return reliable_checkpoint(shapes)


def _unbroken(text: str) -> Column:
    return F.translate(text, "\r\n\t", "   ")


def _starts(shapes: DataFrame) -> DataFrame:
    """State and depth at the start of each block: the blocks before it, composed in order."""
    blocks = shapes.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("q", "net0", "net1")])
    blocks = blocks.withColumn("start", _before("q") % 2)
    blocks = blocks.withColumn("net", F.when(F.col("start") == 0, F.col("net0")).otherwise(F.col("net1")))
    return blocks.select("file", "block", "start", _before("net").alias("depth"))


def _before(name: str) -> Column:
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(earlier), F.lit(0))


def _border(level: int) -> Column:
    """1 where strings are closed at depth ``level``, from the start of the block."""
    end = (F.col("end0") + F.col("start")) % 2
    height = F.col("depth") + F.when(F.col("start") == 0, F.col("r0")).otherwise(F.col("r1"))
    return ((end == 0) & (height == level)).cast("long")


def file_roots(shapes: DataFrame) -> DataFrame:
    """``(file, head, values)``: first sign that is no blank, and how often depth 0 is reached again."""
    placed = shapes.join(_starts(shapes), ["file", "block"])
    return placed.groupBy("file").agg(
        F.min_by("head", F.struct("block", "first")).alias("head"),
        F.sum(_border(0) * F.col("n")).alias("values"),
    )


def cut_records(pieces: DataFrame, shapes: DataFrame, sep: str, level: int, nested: bool) -> DataFrame:
    """Runs of pieces between the places where all strings are closed at depth ``level``.

    Gives ``(file, bucket, k, closed, record)``: ``k`` counts the records of a file from 0,
    ``closed`` is false for what follows the last border. The separator that ends a record
    stays with it if it is a bracket (``nested``).
    """
    found = shapes.join(_starts(shapes), ["file", "block"])
    found = found.withColumn("borders", _border(level) * F.col("n"))
    found = found.groupBy("file", "block", "start", "depth").agg(
        *[F.sum(c).alias(c) for c in ("borders", "bytes")], F.max("size").alias("size")
    )
    whole = W.partitionBy("file")
    found = found.select(
        "file", "block", "start", "depth", _before("borders").alias("k0"),
        F.sum("borders").over(whole).alias("total"),
        # Pieces and separators make up the file, so its last piece has a separator too.
        (F.sum("bytes").over(whole) == F.col("size")).alias("ended"),
    )
    own = W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = _described(pieces, nested).join(found, ["file", "block"]).withColumn("border", _border(level))
    placed = placed.withColumn("k", F.col("k0") + F.coalesce(F.sum("border").over(own), F.lit(0)))
    dealt = placed.withColumn("bucket", F.floor(F.col("k") / BUCKET_RECORDS)).repartition("file", "bucket")
    records = dealt.groupBy("file", "bucket", "k").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))).alias("parts"),
        F.max(F.col("k") < F.col("total")).alias("closed"),
        F.max("ended").alias("ended"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), sep)
    if nested:
        tail = F.when(F.col("closed") | F.col("ended"), F.lit(sep)).otherwise(F.lit(""))
        text = F.concat(text, tail)
    return records.select("file", "bucket", "k", "closed", text.alias("record"))


def split_csv_rows(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """``(file, k, record)``: CSV rows as text, quoted line breaks inside; row 0 is the header.

    Rows that end in a carriage return have plain line breaks inside as well. Rows without
    any sign are left out, as Spark's reader does.
    """
    pieces = scan_pieces(spark, path, "\n", split_bytes)
    rows = cut_records(pieces, describe_blocks(pieces, False), "\n", level=0, nested=False)
    ended = F.col("record").endswith("\r")
    plain = F.replace(F.regexp_replace("record", r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))
    rows = rows.withColumn("record", F.when(ended, plain).otherwise(F.col("record")))
    return rows.where("record <> ''").select("file", "k", "record")


def split_array_parts(pieces: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(file, bucket, k, closed, elements)``: a JSON array's text between its objects, parsed.

    ``elements`` is a VARIANT array, NULL where the text is no list of elements. A file is
    one JSON array if none of its parts is NULL and one of them is not ``closed``.
    """
    parts = cut_records(pieces, shapes, "}", level=1, nested=True)
    first = F.col("k") == 0
    lead = F.when(first, F.lit(r"\A\s*\[")).otherwise(F.lit(r"\A\s*,"))
    opened = F.rlike("record", lead)
    staged = parts.withColumn("opened", opened).withColumn("tail", F.regexp_replace("record", lead, F.lit("")))
    ends = F.col("closed") | F.col("tail").rlike(r"\]\s*\z")
    body = F.when(F.col("closed"), F.col("tail")).otherwise(F.regexp_replace("tail", r"\]\s*\z", ""))
    staged = staged.withColumn("ends", ends).withColumn("body", body)
    # An empty list of elements stands in an empty array or after the last object, without a comma.
    fits = F.when(is_blank(F.col("body")), first == F.col("opened")).otherwise(F.col("opened"))
    parsed = strict_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    return staged.select("file", "bucket", "k", "closed", F.when(fits & F.col("ends"), parsed).alias("elements"))


def array_counts(parts: DataFrame) -> DataFrame:
    """``(file, bucket, before, sound)``: elements in earlier buckets; whether the file is an array."""
    size = F.size(F.try_variant_get("elements", "$", "array<variant>"))
    counts = parts.groupBy("file", "bucket").agg(
        F.sum(size).alias("n"),
        F.bool_and(F.col("elements").isNotNull()).alias("fine"),
        F.bool_or(~F.col("closed")).alias("open"),
    )
    counts = reliable_checkpoint(counts)
    earlier = W.partitionBy("file").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    sound = F.min("fine").over(whole) & F.max("open").over(whole)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return counts.select("file", "bucket", before.alias("before"), sound.alias("sound"))


def array_elements(parts: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """``(file, line_no, record)`` of all sound files: elements in order from 1, cast to ``kind``."""
    listed = F.try_variant_get("elements", "$", f"array<{kind}>")
    own = W.partitionBy("file", "bucket").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("listed", listed)
    placed = placed.withColumn("at", F.coalesce(F.sum(F.size("listed")).over(own), F.lit(0)))
    rows = placed.join(counts.where("sound"), ["file", "bucket"]).select(
        "file", (F.col("before") + F.col("at")).alias("at"), F.posexplode("listed").alias("pos", "record")
    )
    return rows.select("file", (F.col("at") + F.col("pos") + 1).cast("int").alias("line_no"), "record")
