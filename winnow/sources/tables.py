"""Landing files, append-only tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.timefn import iso_text
from winnow.operators.queues import latest_round

RAW_SCHEMA = (
    "source_id string, external_id string, url string, source_family string, observed_at timestamp, published_at timestamp, "
    "payload string, content_hash string, provenance map<string,string>"
)
EXPORT_LIMIT = 500


def read_raw_items(spark: SparkSession, path: str, fmt: str = "json", schema: str = RAW_SCHEMA) -> DataFrame:
    """Raw-item landing files with a fixed envelope (S1); unreadable JSON lines are kept apart in
    ``_corrupt_record``."""
    if fmt == "json":
        return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).format(fmt).load(path)


def append_table(df: DataFrame, path: str, date_of: str = "observed_at", partition: str = "observed_date") -> None:
    """Append to a date-partitioned parquet table.

    Rows are rebalanced by date: AQE splits a date that holds most rows over many tasks and keeps a small one whole.
    """
    out = df.withColumn(partition, F.to_date(date_of)).hint("rebalance", partition)
    out.write.mode("append").partitionBy(partition).parquet(path)


def export_rows(queue: DataFrame, rounds: DataFrame) -> DataFrame:
    """The twenty columns of the candidate export (S8) from queue rows."""
    newest = latest_round(rounds).select("candidate_id", F.col("round_type").alias("latest_round_type"), F.col("announced_at").alias("_at"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return queue.join(newest, "candidate_id", "left").select(
        F.col("candidate_id").alias("id"), F.col("canonical_name").alias("name"), "slug", F.coalesce("organization", F.lit("Unattributed")).alias("organization"),
        "stage", "stack_family", F.coalesce("layer", F.lit("L2")).alias("layer"), F.coalesce("intent_label", F.lit("A4_no_evidence")).alias("africa_intent"),
        F.coalesce("total_score", F.lit(0.0)).alias("africa_score"), zero("total_funding_usd"), "latest_round_type", iso_text(F.col("_at")).alias("latest_round_announced_at"),
        zero("outreach_score"), zero("radar_score"), zero("confidence"), zero("risk"), F.coalesce("state", F.lit("RADAR")).alias("state"),
        F.coalesce("workflow_state", F.lit("NEW")).alias("workflow_state"), F.coalesce(iso_text(F.col("first_seen_at")), F.lit("")).alias("first_seen_at"),
        F.coalesce(iso_text(F.col("last_verified_at")), F.lit("")).alias("last_verified_at"),
    )


JSON_COLUMNS = ("id", "name", "slug", "stage", "stack_family", "outreach_score", "radar_score", "africa_intent", "first_seen_at")


def export_candidates(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write an export as CSV with header (S8) or as nine-column JSON."""
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.select(*JSON_COLUMNS).write.mode("overwrite").json(path)
