"""Streaming jobs: continuous ingestion, step metrics, and writing state updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import text_chunks


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame, int], DataFrame] | None = None,
    output_mode: str = "append",
    trigger: dict | None = None,
):
    """Write every micro-batch into its own ``batch_id`` partition.

    A batch that is run again after a failure overwrites its own partition, so the table
    holds each batch exactly once.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch, batch_id) if prepare else batch
        (
            rows.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.outputMode(output_mode).trigger(**(trigger or {"availableNow": True})).start()


def chunk_stream(
    source: DataFrame, path: str, checkpoint: str, file: str = "file", text: str = "text",
    size: int = 1000, overlap: int = 100, arrived: str | None = None, remember: str | None = None,
):
    """ST1: dropped files become overlapping text chunks, once per (file, content).

    A file that comes again with the same content is left out. What was seen is keyed state of
    the stream, one digest a file and content; no batch reads earlier output, and after a
    restart a batch starts from the state that its first run started from. Without
    ``remember`` the state is kept for good. With it (``"30 days"``) a pair is forgotten that
    long after its time in column ``arrived``, and rows that come later than that are left out.
    Large state wants :func:`answerloom.streaming.states.use_keyed_state`.
    """
    if (arrived is None) != (remember is None):
        raise ValueError("arrived and remember belong together")
    marked = source.withColumn("content", F.sha2(text, 256))
    if remember is None:
        fresh = marked.dropDuplicates([file, "content"])
    else:
        fresh = marked.withWatermark(arrived, remember).dropDuplicatesWithinWatermark([file, "content"])

    def prepare(batch: DataFrame, batch_id: int) -> DataFrame:
        pieces = F.posexplode(text_chunks(text, size, overlap)).alias("pos", "chunk")
        return batch.select(file, "content", pieces)

    return write_batches(fresh, path, checkpoint, prepare)


def windowed_metrics(
    events: DataFrame,
    time: str = "ts",
    key: str = "event_type",
    value: str = "value",
    width: str = "1 day",
    late: str = "1 day",
    decimals: int | None = None,
) -> DataFrame:
    """ST2: count, sum, mean and extremes per key and window; state older than ``late`` is dropped.

    Works in update and append mode; in append mode a window comes once, when it has closed.
    With ``decimals`` the values are exact to that many places, and sums do not depend on
    the batch boundaries; without, they are doubles.
    """
    exact = F.col(value).cast("double" if decimals is None else f"decimal(28,{decimals})")
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(
            F.count("*").alias("n"),
            F.sum(exact).alias("total"),
            F.avg(F.col(value).cast("double")).alias("mean") if decimals is None
            else (F.sum(exact).cast("double") / F.count(exact)).alias("mean"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        )
        .select(F.col("window.start").alias("window_start"), key, "n", "total", "mean", "lowest", "highest")
    )


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update per key of a table written by :func:`write_batches`."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*rest), "batch_id").alias("u")
    return updates.groupBy(*keys).agg(last).select(*keys, "u.*")


def drain(query) -> None:
    """Wait for an available-now query and raise its error, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
