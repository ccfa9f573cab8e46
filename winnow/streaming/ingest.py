"""Streaming ingest, ledger dedup and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winnow.functions.timefn import observed_bucket
from winnow.operators.ledger import append_evidence
from winnow.sources.tables import RAW_SCHEMA, append_table


def stream_raw_items(spark: SparkSession, path: str, fmt: str = "json", schema: str = RAW_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Landing files as a stream (T1). The query's checkpoint is the cursor: it moves only after a
    batch has been committed."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_evidence(raw: DataFrame, horizon: str = "2 hours", bucket_minutes: int = 60) -> DataFrame:
    """Replay filter within a horizon (T2): by external key, then by content key in a bucket. Exact
    dedup beyond the horizon is ``run_ledger``."""
    return (
        raw.withWatermark("observed_at", horizon)
        .dropDuplicatesWithinWatermark(["source_id", "external_id"])
        .withColumn("observed_bucket", observed_bucket(F.col("observed_at"), bucket_minutes))
        .dropDuplicatesWithinWatermark(["source_id", "content_hash", "observed_bucket"])
    )


def run_ledger(raw: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to the ledger exactly once per key, and stop when the input is read.

    Each batch goes through the batch operator against the stored ledger. A batch that is replayed
    after a failure finds its own rows there and adds nothing.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            ledger = spark.read.parquet(ledger_path)
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ledger = None
        if ledger is not None:  # content keys carry their bucket, so a replay of one lies near its day; external keys are narrow
            ledger = ledger.select("source_id", "external_id", "content_hash", "observed_bucket")
        append_table(append_evidence(batch, ledger), ledger_path)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_buckets(raw: DataFrame, minutes: int = 60, lateness: str = "1 hour", contents: bool = False) -> DataFrame:
    """Items per source and tumbling bucket (T3); rows later than the watermark are dropped.

    ``contents`` adds the exact number of distinct contents, by two counts in a row: items per content, then contents per bucket.
    Both keep one row per group in the state store, and the result needs append mode: a bucket comes when the watermark has passed it.
    """
    width = f"{minutes} minutes"
    bucket = F.window("observed_at", width)
    marked = raw.withWatermark("observed_at", lateness)
    if not contents:
        return marked.groupBy(bucket, "source_id").agg(F.count("*").alias("n"))
    per_content = marked.groupBy(bucket, "source_id", "content_hash").agg(F.count("*").alias("m"))
    again = F.window(F.window_time("window"), width)
    return per_content.groupBy(again, "source_id").agg(F.sum("m").alias("n"), F.count("content_hash").alias("contents"))


def stream_velocity(evidence: DataFrame, days: int = 14, lateness: str = "1 day") -> DataFrame:
    """Evidence per candidate in a window that slides by a day (T4)."""
    return (
        evidence.withWatermark("observed_at", lateness)
        .groupBy(F.window("observed_at", f"{days} days", "1 day"), "candidate_id")
        .agg(F.count("*").alias("n"))
    )
