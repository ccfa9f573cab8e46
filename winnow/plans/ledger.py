"""Queries over the evidence ledger (L, S2, S4, T7, SO4, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.text import canonical_json_hash
from winnow.operators import ledger as L
from winnow.plans.registry import query
from winnow.plans.roles import AS_OF, cte, r, register, role, sql_t, t, table

_KEPT = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY source_id, content_hash, observed_bucket ORDER BY observed_at, external_id, content_hash) rn
  FROM evidence) WHERE rn = 1)
"""


@query("content_hash_text", "S2", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(
    "content_hash_json",
    "S2",
    "SELECT event_id, sha256(replace(props, ' ', '')) AS content_hash FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", canonical_json_hash(F.col("props")).alias("content_hash"))


@query(
    "enabled_items",
    "S4",
    cte("evidence", "register")
    + "SELECT e.external_id, e.source_id FROM evidence e WHERE e.source_id IN (SELECT source_id FROM register WHERE NOT kill_switch)",
)
def _(spark, sf):
    return L.enabled_items(role(spark, sf, "evidence"), register(spark)).select("external_id", "source_id")


@query(
    "ledger_append",
    "L1 N20",
    cte("evidence").rstrip() + ",\n" + _KEPT
    + f"SELECT source_id, external_id, observed_bucket, {sql_t('observed_at')} AS observed_at, "
    "'https://feed.example.com/' || source_id || '/' || external_id || '?token=<redacted>' AS url, "
    "CAST(0.85 AS DOUBLE) AS reliability FROM kept",
)
def _(spark, sf):
    out = L.append_evidence(role(spark, sf, "evidence"), unique_external_ids=True)
    return out.select("source_id", "external_id", "observed_bucket", t("observed_at").alias("observed_at"), "url", "reliability")


@query(
    "ledger_append_greedy",
    "L1",
    cte("evidence").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """, raw AS (SELECT DISTINCT source_id, CAST(candidate_id AS STRING) || '-' || CAST(dayofmonth(observed_at) AS STRING) AS external_id, content_hash,
    observed_bucket, observed_at FROM evidence),
base AS (SELECT *, row_number() OVER (ORDER BY observed_at, external_id, content_hash) AS place FROM (SELECT source_id, external_id, content_hash,
    observed_bucket, min(observed_at) AS observed_at FROM raw GROUP BY ALL)),
open_rows AS (SELECT place, source_id, external_id, content_hash, observed_bucket, false AS taken FROM base
UNION ALL
SELECT place, source_id, external_id, content_hash, observed_bucket, wins FROM (
  SELECT *, bool_or(wins) OVER (PARTITION BY source_id, external_id) AS ext_taken, bool_or(wins) OVER (PARTITION BY source_id, content_hash, observed_bucket) AS content_taken FROM (
    SELECT *, place = min(place) OVER (PARTITION BY source_id, external_id)
      AND place = min(place) OVER (PARTITION BY source_id, content_hash, observed_bucket) AS wins FROM open_rows WHERE NOT taken))
WHERE wins OR NOT (ext_taken OR content_taken))
SELECT source_id, external_id, content_hash, observed_bucket FROM open_rows WHERE taken""",
)
def _(spark, sf):
    """Replayed batch: external ids repeat with changing content, so the rounds are needed."""
    raw = role(spark, sf, "evidence").withColumn(
        "external_id", F.concat(F.col("candidate_id").cast("string"), F.lit("-"), F.dayofmonth("observed_at"))
    )
    return L.append_evidence(raw).select("source_id", "external_id", "content_hash", "observed_bucket")


@query(
    "evidence_links",
    "L2",
    cte("evidence")
    + """SELECT candidate_id, evidence_id,
  CASE WHEN row_number() OVER (PARTITION BY candidate_id ORDER BY observed_at, evidence_id) = 1
       THEN 'primary_discovery' ELSE 'corroboration' END AS link_type FROM evidence""",
)
def _(spark, sf):
    return L.link_evidence(role(spark, sf, "evidence")).select("candidate_id", "evidence_id", "link_type")


@query(
    "evidence_of_candidate",
    "L3",
    cte("evidence")
    + f"SELECT candidate_id, evidence_id, source_id, {sql_t('observed_at')} AS observed_at FROM evidence",
)
def _(spark, sf):
    ev = role(spark, sf, "evidence")
    links = L.link_evidence(ev)
    return L.evidence_for(links, ev.drop("candidate_id")).select(
        "candidate_id", "evidence_id", "source_id", t("observed_at").alias("observed_at")
    )


@query(
    "source_health",
    "L4",
    cte("runs")
    + f""", last AS (SELECT source_id, max(CASE WHEN success THEN run_at END) AS ls, max(run_at) AS lr FROM runs GROUP BY 1)
SELECT l.source_id, {sql_t('ls')} AS last_success, {sql_t('lr')} AS last_run,
  (SELECT count(*) FROM runs r WHERE r.source_id = l.source_id AND NOT r.success AND (ls IS NULL OR r.run_at > ls)) AS consecutive_failures
FROM last l""",
)
def _(spark, sf):
    h = L.source_health(role(spark, sf, "runs"))
    return h.select("source_id", t("last_success").alias("last_success"), t("last_run").alias("last_run"), "consecutive_failures")


@query(
    "source_listing",
    "L5",
    cte("evidence", "register")
    + f""", last AS (SELECT source_id, max(observed_at) AS lr FROM evidence GROUP BY 1)
SELECT r.source_id, r.family, r.tier, {sql_t('lr')} AS last_success, CAST(0 AS BIGINT) AS consecutive_failures
FROM register r LEFT JOIN last l ON r.source_id = l.source_id""",
)
def _(spark, sf):
    runs = role(spark, sf, "evidence").select("source_id", F.col("observed_at").alias("run_at"), F.lit(True).alias("success"))
    out = L.list_sources(register(spark), L.source_health(runs))
    return out.select("source_id", "family", "tier", t("last_success").alias("last_success"), "consecutive_failures")


@query(
    "audit_trail",
    "L6",
    cte("snapshots")
    + f"""SELECT 'analyst' AS actor, 'workflow_state_transition' AS action, CAST(candidate_id AS STRING) AS target_id,
  '{{"value":"NEW"}}' AS before_state, '{{"value":"' || workflow_state || '"}}' AS after_state, {sql_t('calculated_at')} AS at
FROM snapshots WHERE workflow_state <> 'NEW'""",
)
def _(spark, sf):
    ev = role(spark, sf, "snapshots").filter("workflow_state <> 'NEW'").select(
        F.lit("analyst").alias("actor"),
        F.col("candidate_id").cast("string").alias("target_id"),
        F.lit("NEW").alias("before"),
        F.col("workflow_state").alias("after"),
        F.lit(None).cast("string").alias("reason"),
        F.col("calculated_at").alias("at"),
    )
    return L.audit_rows(ev, "workflow_state_transition", "candidate").select(
        "actor", "action", "target_id", "before_state", "after_state", t("at").alias("at")
    )


@query(
    "dedup_rate",
    "L7",
    cte("evidence").rstrip() + ",\n" + _KEPT
    + """, a AS (SELECT source_id, CAST(observed_at AS DATE) AS day, count(*) AS raw_items FROM evidence GROUP BY 1, 2),
b AS (SELECT source_id, CAST(observed_at AS DATE) AS day, count(*) AS kept_items FROM kept GROUP BY 1, 2)
SELECT a.source_id, CAST(a.day AS STRING) AS day, raw_items, coalesce(kept_items, 0) AS kept_items,
  round(1.0::DOUBLE - coalesce(kept_items, 0)::DOUBLE / raw_items, 6) AS duplicate_rate
FROM a LEFT JOIN b ON a.source_id = b.source_id AND a.day = b.day""",
)
def _(spark, sf):
    raw = role(spark, sf, "evidence")
    out = L.dedup_rate(raw, L.append_evidence(raw, unique_external_ids=True))
    return out.select("source_id", F.col("day").cast("string").alias("day"), "raw_items", "kept_items", r("duplicate_rate").alias("duplicate_rate"))


@query(
    "retention_expiry",
    "L8",
    cte("evidence", "register")
    + f"""SELECT e.external_id FROM evidence e LEFT JOIN register r ON e.source_id = r.source_id
WHERE r.retention_days IS NULL OR (epoch(TIMESTAMP '{AS_OF}') - epoch(e.observed_at)) / 86400 <= r.retention_days""",
)
def _(spark, sf):
    return L.expire(role(spark, sf, "evidence"), register(spark), AS_OF).select("external_id")


@query(
    "evidence_drill_down",
    "L9",
    cte("evidence") + "SELECT external_id, source_id, payload FROM evidence",
)
def _(spark, sf):
    raw = role(spark, sf, "evidence")
    return L.evidence_detail(raw.drop("payload"), raw).select("external_id", "source_id", "payload")


@query(
    "kill_switch_events",
    "L10",
    cte("evidence", "register")
    + """, last AS (SELECT source_id, arg_max(CAST(external_id AS BIGINT) % 2 = 0, row(observed_at, external_id)) AS d FROM evidence GROUP BY 1)
SELECT r.source_id, coalesce(d, kill_switch) AS kill_switch FROM register r LEFT JOIN last l ON r.source_id = l.source_id""",
)
def _(spark, sf):
    events = role(spark, sf, "evidence").select(
        "source_id",
        F.col("observed_at").alias("at"),
        F.col("external_id").alias("event_id"),
        (F.col("external_id").cast("bigint") % 2 == 0).alias("disabled"),
    )
    return L.apply_kill_switches(register(spark), events).select("source_id", "kill_switch")


@query(
    "trailing_backfill",
    "T7",
    cte("evidence")
    + f"SELECT external_id FROM evidence WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND observed_at <= TIMESTAMP '{AS_OF}'",
)
def _(spark, sf):
    return L.trailing_window(role(spark, sf, "evidence"), AS_OF).select("external_id")


@query(
    "register_drift",
    "SO4",
    cte("evidence", "register")
    + """SELECT source_id, 'unregistered' AS drift FROM (SELECT DISTINCT source_id FROM evidence EXCEPT SELECT source_id FROM register)
UNION ALL SELECT source_id, 'silent' FROM (SELECT source_id FROM register EXCEPT SELECT source_id FROM evidence)""",
)
def _(spark, sf):
    return L.register_drift(register(spark), role(spark, sf, "evidence"))


def _scratch(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    from uuid import uuid4

    from winnow.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"


@query("landing_files", "S1", cte("evidence") + "SELECT source_id, external_id, payload FROM evidence")
def _(spark, sf):
    """Raw items written as JSON lines and read back through the fixed envelope."""
    from winnow.sources.tables import read_raw_items

    path = _scratch(spark)
    role(spark, sf, "evidence").select("source_id", "external_id", "url", "source_family", "observed_at", "payload").write.json(path)
    return read_raw_items(spark, path).select("source_id", "external_id", "payload")


@query(
    "appended_table",
    "S10",
    cte("evidence") + "SELECT strftime(observed_at, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT external_id) AS n_ids FROM evidence GROUP BY 1",
)
def _(spark, sf):
    """Two appends, one per half of the sources, to a date-partitioned table."""
    from winnow.sources.tables import append_table

    path = _scratch(spark)
    ev = role(spark, sf, "evidence")
    early = F.col("source_id").isin("view", "click")
    append_table(ev.filter(early), path)
    append_table(ev.filter(~early), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("observed_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("external_id").alias("n_ids"))
