"""Structured Streaming jobs (ST-01…03).

* ST-01 file-drop ingest: a file-source stream over the landing folder; every micro-batch
  hands the *new files* (the checkpoint guarantees each file once) to the batch ingest
  (classification, cleaning, idempotent publish).
* ST-02 hour-slot totals: event-time hourly windows per event type.  State is one row per
  (hour, type), bounded by the calendar, so no watermark is needed and no late row is lost.
  Every micro-batch writes the windows it changed under its own number and day; readers take the
  latest version of each window, a repeated batch overwrites its own folder, and older versions
  are compacted.  The same job compares the latest day with its baseline (AG-42).
* ST-03 duplicate order suppression: every micro-batch appends the orders whose number the
  table does not hold yet (IO-11), so a repeat is dropped and a late order kept however far
  apart they arrive, and a repeated batch adds nothing.  Of the table only the ranges of keys that
  the micro-batch has are read.

Checkpoints live under the shared folder named by ``spark.checkpoint.dir`` so a restarted
driver or lost executors resume from the last committed batch.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import keep_last
from ..operators.realtime import day_deviations
from ..session import scratch_path
from ..sources.files import file_path, ingest_files, read_raw
from ..sources.publish import _fs, append_keyed, append_new_keys, remove, within_key_runs


def file_ingest_stream(spark: SparkSession, landing: str, root: str, checkpoint: str | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """ST-01: new files in ``landing`` -> batch ingest (IO-21) per micro-batch."""
    lines = spark.readStream.format("text").load(landing).select(file_path().alias("path"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # files of this batch only
        if paths:
            # a failed kind fails the micro-batch: it is not committed, so its files are taken again
            ingest_files(batch.sparkSession, paths, root, raise_failures=True)

    w = lines.writeStream.foreachBatch(per_batch).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "ckpt/file_ingest"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def slot_totals(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value",
                user: str = "user_id") -> DataFrame:
    """ST-02: hourly event-time totals per type on a streaming (or static) frame.

    Windows need an instant type, so a TIMESTAMP_NTZ event time is read as TIMESTAMP in the
    session time zone (UTC here: wall clock unchanged) and window bounds are returned as NTZ.
    """
    return (events.withColumn(ts, F.col(ts).cast("timestamp_ltz"))
                  .groupBy(F.window(ts, "1 hour").alias("w"), F.col(kind).alias("type"))
                  .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("amount"),
                       F.approx_count_distinct(user).alias("users"))
                  .select(F.col("w.start").cast("timestamp_ntz").alias("slot_start"),
                          F.col("w.end").cast("timestamp_ntz").alias("slot_end"), "type",
                          "events", "amount", "users"))


def start_slot_totals(spark: SparkSession, source: str, out: str, checkpoint: str | None = None,
                      available_now: bool = True, files_per_batch: int | None = None, anomalies: str | None = None,
                      compact_every: int = 16) -> StreamingQuery:
    """ST-02: stream Parquet event files from ``source`` into versions of hourly windows at ``out``, by day.

    With ``anomalies`` every micro-batch also writes there how the latest day's slots deviate from their baseline (AG-42).
    Every ``compact_every`` batches the older versions become one, so a read never opens more than that many."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id and batch_id % compact_every == 0:
            compact_slot_totals(session, out, batch_id - 1)
        batch.withColumn("day", F.to_date("slot_start")).write.mode("overwrite").partitionBy("day") \
             .option("partitionOverwriteMode", "static").parquet(f"{out}/version={batch_id}")
        if anomalies:
            slot_anomalies(session, out).write.mode("overwrite").parquet(f"{anomalies}/batch={batch_id}")

    q = (slot_totals(reader.parquet(source)).writeStream.foreachBatch(per_batch).outputMode("update")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt/slot_totals")))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


_TOTALS = ["slot_end", "events", "amount", "users"]


def _versions(spark: SparkSession, out: str, since=None) -> DataFrame:
    df = spark.read.option("basePath", out).parquet(f"{out}/version=*")
    return df if since is None else df.where(F.col("day") >= F.lit(since))


def read_slot_totals(spark: SparkSession, out: str, since=None) -> DataFrame:
    """The current totals: the latest version of each window; with ``since`` (a date) only folders of later days are read."""
    return keep_last(_versions(spark, out, since), ["slot_start", "type"], ["version"], _TOTALS)


def compact_slot_totals(spark: SparkSession, out: str, upto: int) -> None:
    """Versions before ``upto`` become part of it: the last version of each window that ``upto`` does not change is added
    to it, then the older folders go.  ``upto`` must be of a committed batch, which is never written again.

    A reader sees right totals at every moment, and a compaction that was cut short may be repeated: what is added
    equals the version that the window had."""
    fs, base = _fs(spark, out)
    if not fs.exists(base):
        return
    names = [x.getPath().getName() for x in fs.listStatus(base) if x.getPath().getName().startswith("version=")]
    older = sorted(v for v in (int(n.split("=")[1]) for n in names) if v < upto)
    if not older:
        return
    held = _versions(spark, out).where(F.col("version") <= upto)
    last = keep_last(held, ["slot_start", "type"], ["version"], [*_TOTALS, "version", "day"]).where(F.col("version") < upto).drop("version")
    last.repartition("day").write.mode("append").partitionBy("day").parquet(f"{out}/version={upto}")
    for v in older:
        remove(spark, f"{out}/version={v}")


def slot_anomalies(spark: SparkSession, out: str, days: int = 7, pct: float = 20.0) -> DataFrame:
    """ST-02 / AG-42: events of the latest day's hours against their mean over the previous ``days`` days; no other
    days are read (the latest is one value of the folder names)."""
    latest = _versions(spark, out).agg(F.max("day")).first()[0]
    since = None if latest is None else latest - timedelta(days=days)
    totals = read_slot_totals(spark, out, since)
    return day_deviations(totals.groupBy(F.to_date("slot_start").alias("day"), F.date_format("slot_start", "HH:00").alias("slot"))
                          .agg(F.sum("events").alias("v")), days, pct)


def read_slot_anomalies(spark: SparkSession, anomalies: str) -> DataFrame:
    """The deviations as of the last micro-batch."""
    df = spark.read.parquet(anomalies)
    return df.join(F.broadcast(df.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")


def start_dedupe_orders(spark: SparkSession, source: str, out: str, key: str = "order_no", ts: str = "applied_at",
                        checkpoint: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """ST-03: append each order once, the earliest row of its micro-batch."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        have = read_raw(batch.sparkSession, out.rstrip("/").rsplit("/", 1)[1], schema, out.rstrip("/").rsplit("/", 1)[0])
        append_keyed(append_new_keys(batch, within_key_runs(have, batch, key), key, [ts]), out, key)

    return (reader.parquet(source).writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt/dedupe_orders"))
            .trigger(availableNow=True).start())
