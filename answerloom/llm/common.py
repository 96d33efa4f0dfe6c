"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.session import scratch_path

#: Held-out rows of the classifiers: one id in five, by the checksum of its digits.
FOLDS = 5


#: What one batch to a Python worker may hold. Buffers on both sides grow with it, outside
#: the heap that Spark manages.
BATCH_ROWS = 1000
WORKER_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to the sizes above (lower settings stay)."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", WORKER_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, … that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found, k = name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns ``doc_id`` and ``text``; whatever else the table has is pruned here."""
    bounded_batches(df.sparkSession)
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that no model may learn from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends at these files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(key: Column, rows: int, wanted: int) -> Column:
    """Predicate that keeps about ``wanted`` of ``rows`` rows, the same ones in every run."""
    if rows <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < int(wanted / rows * (1 << 30))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each part, one row at least."""
    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)
