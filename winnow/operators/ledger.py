"""Append-only evidence ledger, provenance links, source health and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.matching import first_come
from winnow.functions.ordered import top_n
from winnow.functions.text import redacted_url
from winnow.functions.timefn import age_days, observed_bucket, ts
from winnow.session import cut_lineage

EXTERNAL_KEY = ["source_id", "external_id"]
CONTENT_KEY = ["source_id", "content_hash", "observed_bucket"]
# Fixed value: reliability of a row whose source states none.
DEFAULT_RELIABILITY = 0.85


def prepare_evidence(raw: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Raw items with bucket, redacted URL and default reliability: what the ledger stores."""
    out = raw.withColumn("observed_bucket", observed_bucket(F.col("observed_at"), bucket_minutes))
    if "url" in raw.columns:
        out = out.withColumn("url", redacted_url(F.col("url")))
    reliability = F.col("reliability") if "reliability" in raw.columns else F.lit(None)
    return out.withColumn(
        "reliability", F.coalesce(reliability.cast("double"), F.lit(DEFAULT_RELIABILITY))
    )


def append_evidence(
    raw: DataFrame,
    ledger: DataFrame | None = None,
    bucket_minutes: int = 60,
    unique_external_ids: bool = False,
) -> DataFrame:
    """Rows of ``raw`` to append (L1).

    In order of ``(observed_at, external_id, content_hash)`` a row is accepted unless an accepted
    row, or the ledger, already has its external key, or its content key in the same bucket. A row
    rejected on content does not reserve its external id.

    ``unique_external_ids`` states that the batch holds each external key once; one rank-1 filter
    on the content key is then exact. Otherwise ``first_come`` decides the narrow rows that conflict with any other, with the
    sequential result, in rounds that grow with the logarithm of the longest chain of conflicts.

    A row without a source, external id, hash or time has no keys; it is not accepted (see ``keyless_items``).
    """
    rows = prepare_evidence(raw, bucket_minutes).filter(~_keyless())
    if ledger is not None:
        rows = rows.join(ledger.select(*EXTERNAL_KEY), EXTERNAL_KEY, "left_anti")
        rows = rows.join(ledger.select(*CONTENT_KEY), CONTENT_KEY, "left_anti")
    arrival = [F.col("observed_at"), F.col("external_id"), F.col("content_hash")]
    if unique_external_ids:
        return top_n(rows, CONTENT_KEY, arrival)
    # A replay of one event in one bucket is the same row twice: keep one before the rounds.
    key = [*EXTERNAL_KEY, "content_hash", "observed_bucket"]
    rows = cut_lineage(top_n(rows, key, arrival))
    narrow = rows.select(*dict.fromkeys([*key, "observed_at"]))
    by_ext = narrow.groupBy(*EXTERNAL_KEY).agg(F.count("*").alias("_n_e"))
    by_con = narrow.groupBy(*CONTENT_KEY).agg(F.count("*").alias("_n_c"))
    counted = cut_lineage(narrow.join(by_ext, EXTERNAL_KEY).join(by_con, CONTENT_KEY))
    accepted = counted.filter("_n_e = 1 AND _n_c = 1").select(*key)
    rest = counted.filter("_n_e > 1 OR _n_c > 1").select(*narrow.columns)
    if not rest.isEmpty():
        won, _ = first_come(rest, EXTERNAL_KEY, CONTENT_KEY, ["observed_at", "external_id", "content_hash"])
        accepted = accepted.unionByName(won.select(*key))
    return rows.join(accepted, key, "left_semi").select(*rows.columns)


def _keyless() -> Column:
    return F.col("source_id").isNull() | F.col("external_id").isNull() | F.col("content_hash").isNull() | F.col("observed_at").isNull()


def keyless_items(raw: DataFrame) -> DataFrame:
    """The rows of ``raw`` that the ledger cannot take, because a part of their keys is missing."""
    return raw.filter(_keyless())


def link_evidence(observations: DataFrame) -> DataFrame:
    """Unique (candidate, evidence) edges; the first is ``primary_discovery`` (L2).

    The first edge per candidate is found by aggregation, so a candidate with very many edges does
    not need a window of its own.
    """
    edges = observations.groupBy("candidate_id", "evidence_id").agg(F.min("observed_at").alias("observed_at"))
    first = edges.groupBy("candidate_id").agg(
        F.min(F.struct("observed_at", "evidence_id")).alias("_f")
    )
    return edges.join(first, "candidate_id").select(
        "candidate_id",
        "evidence_id",
        "observed_at",
        F.when(F.col("evidence_id") == F.col("_f.evidence_id"), F.lit("primary_discovery"))
        .otherwise(F.lit("corroboration"))
        .alias("link_type"),
    )


def evidence_for(links: DataFrame, evidence: DataFrame, candidate_ids=None) -> DataFrame:
    """Evidence with its candidates, newest first when single candidates are asked for (L3)."""
    if candidate_ids is not None:
        links = links.filter(F.col("candidate_id").isin(list(candidate_ids)))
    out = links.select("candidate_id", "evidence_id", "link_type").join(evidence, "evidence_id")
    if candidate_ids is None:
        return out
    return out.orderBy("candidate_id", F.col("observed_at").desc(), "evidence_id")


def source_health(runs: DataFrame) -> DataFrame:
    """Per source: last success and failures since it (L4)."""
    last = runs.groupBy("source_id").agg(
        F.max(F.when(F.col("success"), F.col("run_at"))).alias("last_success"),
        F.max("run_at").alias("last_run"),
    )
    failures = (
        runs.filter(~F.col("success"))
        .join(last, "source_id")
        .filter(F.col("last_success").isNull() | (F.col("run_at") > F.col("last_success")))
        .groupBy("source_id")
        .agg(F.count("*").alias("_n"))
    )
    return last.join(failures, "source_id", "left").select(
        "source_id",
        "last_success",
        "last_run",
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("consecutive_failures"),
    )


def list_sources(register: DataFrame, health: DataFrame) -> DataFrame:
    """Register with health columns; sources that never ran keep nulls and no failures."""
    return register.join(health, "source_id", "left").withColumn(
        "consecutive_failures", F.coalesce("consecutive_failures", F.lit(0).cast("bigint"))
    )


def audit_rows(events: DataFrame, action: str, target_type: str) -> DataFrame:
    """Audit-log rows with before and after structs as JSON."""
    return events.select(
        "actor",
        F.lit(action).alias("action"),
        F.lit(target_type).alias("target_type"),
        "target_id",
        F.to_json(F.struct(F.col("before").alias("value"))).alias("before_state"),
        F.to_json(F.struct(F.col("after").alias("value"))).alias("after_state"),
        "reason",
        "at",
    )


def dedup_rate(raw: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of raw items not appended, per source and day."""
    keys = ["source_id", "day"]
    day = F.to_date("observed_at").alias("day")
    seen = raw.groupBy("source_id", day).agg(F.count("*").alias("raw_items"))
    kept = evidence.groupBy("source_id", day).agg(F.count("*").alias("kept_items"))
    kept_n = F.coalesce("kept_items", F.lit(0).cast("bigint"))
    return seen.join(kept, keys, "left").select(
        *keys,
        "raw_items",
        kept_n.alias("kept_items"),
        (F.lit(1.0) - kept_n / F.col("raw_items")).alias("duplicate_rate"),
    )


def expire(evidence: DataFrame, register: DataFrame, as_of) -> DataFrame:
    """Evidence still within its source's ``retention_days`` (L8). Unregistered sources keep all."""
    limits = register.select("source_id", "retention_days")
    return (
        evidence.join(limits, "source_id", "left")
        .filter(
            F.col("retention_days").isNull()
            | (age_days(F.col("observed_at"), as_of) <= F.col("retention_days"))
        )
        .drop("retention_days")
    )


def evidence_detail(evidence: DataFrame, raw: DataFrame) -> DataFrame:
    """Ledger rows with the raw payload they were taken from."""
    payloads = top_n(
        raw.select("source_id", "content_hash", "payload", F.col("external_id").alias("_x")),
        ["source_id", "content_hash"],
        [F.col("_x")],
    ).drop("_x")
    return evidence.join(payloads, ["source_id", "content_hash"], "left")


def apply_kill_switches(register: DataFrame, events: DataFrame) -> DataFrame:
    """Register with the last toggle per source applied."""
    last = events.groupBy("source_id").agg(
        F.max_by("disabled", F.struct("at", "event_id")).alias("_d")
    )
    return register.join(last, "source_id", "left").withColumn(
        "kill_switch", F.coalesce("_d", "kill_switch")
    ).drop("_d")


def enabled_items(raw: DataFrame, register: DataFrame) -> DataFrame:
    """Items of registered sources whose kill switch is off."""
    return raw.join(register.filter(~F.col("kill_switch")).select("source_id"), "source_id", "left_semi")


def trailing_window(raw: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Raw items to re-scan in a backfill (T7); the ledger's idempotency makes overlap safe."""
    return raw.filter(
        (F.col("observed_at") <= ts(as_of)) & (age_days(F.col("observed_at"), as_of) <= days)
    )


def register_drift(register: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sources on one side only: ``unregistered`` in data, ``silent`` in the register (SO4)."""
    r = register.select("source_id").distinct()
    e = evidence.select("source_id").distinct()
    return (
        e.exceptAll(r).withColumn("drift", F.lit("unregistered"))
        .unionByName(r.exceptAll(e).withColumn("drift", F.lit("silent")))
    )
