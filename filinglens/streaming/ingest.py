"""Structured Streaming entries (ST1-ST3).

* ``stream_ingest``: arriving raw filings (a file source) → parse → embed →
  ``foreachBatch`` upsert into the chunk index. The upsert replaces whole
  filings, so replaying a micro-batch after a failure leaves the index as
  it was after the first run. No watermark: late files are ingested too.
* ``stream_distinct``: copies of a row that arrive in any later micro-batch
  are dropped; the keys seen are kept until the watermark passes them.
* ``stream_closed_windows``: arrivals per hour in append mode; a window is
  written once, when the watermark has passed its end, and leaves the state.
* ``stream_hourly_counts``: arrivals per hour; complete mode, so every
  window's final count is kept.

All run with ``trigger(availableNow=True)``: process everything present,
then stop. Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.operators.embedding import embed
from filinglens.operators.index import upsert_chunks
from filinglens.operators.parse import parse_filings
from filinglens.options import Options
from filinglens.session import scratch_path


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Files named ``file_glob`` in ``folder``, or the part files of folders
    of that name (a table of many files)."""
    # In braces the name is a pattern, which may match a file or a folder.
    path = f"{folder.rstrip('/')}/{{{file_glob}}}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_ingest(
    spark: SparkSession,
    pages: DataFrame,
    index_path: str,
    *,
    id_col: str = "page_id",
    company_col: str = "company",
    opts: Options = Options(),
    checkpoint: str | None = None,
) -> None:
    """Run the ingest stream to completion (availableNow). Of several copies
    of a filing in a micro-batch the newest file's counts; a copy in a later
    micro-batch replaces it, however old its file is."""
    raw = pages.select(id_col, company_col, "html", F.col("_metadata.file_modification_time").alias("_arrived"))
    keep = [id_col, company_col]

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        newest = F.max_by(F.struct(company_col, "html"), F.struct("_arrived", "html"))
        batch = batch.groupBy(id_col).agg(newest.alias("_f")).select(id_col, f"_f.{company_col}", "_f.html")
        key = F.col(id_col).cast("string").alias("accession_number")
        chunks = parse_filings(batch, "html", keep=keep, opts=opts)
        rows = embed(chunks, "text").withColumn("accession_number", key)
        upsert_chunks(
            spark, index_path, rows, filing_key="accession_number", company_col=company_col, filings=batch.select(key), opts=opts
        )

    q = (
        raw.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "ingest-stream"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def stream_hourly_counts(
    spark: SparkSession,
    events: DataFrame,
    out_path: str,
    *,
    ts_col: str = "ts",
    watermark: str = "40 days",
    checkpoint: str | None = None,
) -> None:
    """Hourly counts per event type; the full result table is rewritten each
    micro-batch (complete mode keeps all windows, so late data always counts)."""
    # Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read in the
    # session time zone (UTC), which keeps its wall-clock value.
    timed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    agg = (
        timed.withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
    )

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (
        agg.writeStream.outputMode("complete")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "hourly-stream"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def stream_distinct(
    spark: SparkSession,
    rows: DataFrame,
    out_path: str,
    *,
    key: list[str],
    time_col: str,
    delay: str = "7 days",
    checkpoint: str | None = None,
) -> list[int]:
    """Appends each key's first row to ``out_path`` (Parquet). A copy is
    dropped, in whatever micro-batch it comes, if its time is within ``delay`` of the first
    one's; keys older than that leave the state, which so holds ``delay`` worth of keys, not
    the history. Rows later than the watermark, or without a time, are not written. Restarting from the
    checkpoint writes nothing twice. Returns the state's rows after each micro-batch."""
    timed = rows.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    q = (
        timed.dropDuplicatesWithinWatermark(key)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "distinct-stream"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def stream_closed_windows(
    spark: SparkSession,
    events: DataFrame,
    out_path: str,
    *,
    ts_col: str = "ts",
    by: str = "event_type",
    value_col: str = "value",
    delay: str = "2 days",
    width: str = "1 hour",
    checkpoint: str | None = None,
) -> list[dict]:
    """Counts per window and ``by`` of the windows that the watermark (the
    latest time less ``delay``) has closed, appended to ``out_path`` (Parquet): w,
    ``by``, n_events, value_cents. Only windows of the last ``delay`` stay in
    the state. A row that comes after its window was closed is dropped, one
    without a time too; dropped rows are counted by Spark. Restarting
    from the checkpoint writes nothing twice. Returns per micro-batch the
    state's rows (``state``) and the rows dropped as late, each counted after the
    partial aggregation (``late``)."""
    timed = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    agg = timed.groupBy(F.window(ts_col, width).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.round(F.col(value_col) * 100).cast("long")).alias("value_cents"))
    q = (
        agg.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "closed-windows"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    steps = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return [{"state": s["numRowsTotal"], "late": s["numRowsDroppedByWatermark"]} for s in steps]
