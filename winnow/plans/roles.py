"""How the driver tables play the engine's roles.

Each role is a table and a list of (column, expression). The expressions are plain SQL that Spark
and DuckDB read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
LATER = "2024-02-16 00:00:00"
ORDERS_AS_OF = "2001-08-05 00:00:00"

_STAGES = (
    "CASE {x} % 7 WHEN 0 THEN 'S0_research_hint' WHEN 1 THEN 'S1_devnet_prototype' "
    "WHEN 2 THEN 'S2_public_testnet' WHEN 3 THEN 'S3_incentivized_testnet' "
    "WHEN 4 THEN 'S4_mainnet_announced' WHEN 5 THEN 'S5_early_mainnet' "
    "ELSE 'S6_established_archived' END"
)
_LABELS = (
    "CASE {x} % 5 WHEN 0 THEN 'A1_explicit_intent' WHEN 1 THEN 'A2_active_regional_motion' "
    "WHEN 2 THEN 'A3_africa_compatible' WHEN 3 THEN 'A4_no_evidence' "
    "ELSE 'A5_already_covered' END"
)

ROLES: dict[str, tuple[str, dict[str, str]]] = {
    "evidence": (
        "events",
        {
            "source_id": "event_type",
            "external_id": "CAST(event_id AS STRING)",
            "evidence_id": "CAST(event_id AS STRING)",
            "candidate_id": "user_id",
            "observed_at": "CAST(ts AS TIMESTAMP)",
            "payload": "props",
            "source_family": "CASE event_type WHEN 'view' THEN 'registry' WHEN 'click' THEN 'code_search' "
            "WHEN 'error' THEN 'social' WHEN 'purchase' THEN 'careers' ELSE 'official_web' END",
            "url": "'https://feed.example.com/' || event_type || '/' || CAST(event_id AS STRING) || '?token=' || CAST(user_id AS STRING)",
        },
    ),
    "runs": (
        "events",
        {
            "source_id": "event_type || '-' || CAST(user_id AS STRING)",
            "run_at": "CAST(ts AS TIMESTAMP)",
            "success": "value < 60",
        },
    ),
    "probes": (
        "events",
        {
            "probe_id": "event_id",
            "candidate_id": "user_id",
            "endpoint_hash": "'e' || CAST(user_id AS STRING)",
            "network_id": "'n' || CAST(user_id AS STRING)",
            "observed_at": "CAST(ts AS TIMESTAMP)",
            "probe_round": "CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END",
            "success": "event_type <> 'error'",
            "failure_class": "CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'rate_limited' "
            "WHEN 1 THEN 'unreachable' WHEN 2 THEN 'identity_mismatch' ELSE 'method_unsupported' END END",
            "identity_fingerprint": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'fp' || CAST(user_id % 3 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS STRING) END",
            "block_height": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END",
            "chain_id": "CAST(user_id % 40 AS STRING)",
            "genesis_hash": "CASE WHEN event_id % 5 = 0 THEN '0xg' || CAST(event_id % 3 AS STRING) END",
        },
    ),
    "activity": (
        "events",
        {
            "candidate_id": "user_id",
            "channel": "CASE event_type WHEN 'view' THEN 'github' WHEN 'click' THEN 'website' WHEN 'error' THEN 'rpc' "
            "WHEN 'purchase' THEN 'x' ELSE 'forum' END",
            "observed_at": "CAST(ts AS TIMESTAMP)",
            "snapshot_id": "event_id",
            "last_activity_at": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) - INTERVAL '1' DAY * (event_id % 240) END",
            "followers": "CAST(floor(value * 100) AS BIGINT)",
            "stars": "CAST(floor(value) AS BIGINT)",
            "contributors": "event_id % 30",
            "commits_last_30d": "event_id % 60",
            "releases_last_90d": "event_id % 8",
        },
    ),
    "rounds": (
        "orders",
        {
            "candidate_id": "o_custkey",
            "round_id": "o_orderkey",
            "round_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'seed' WHEN '2-HIGH' THEN 'series_a' "
            "WHEN '3-MEDIUM' THEN 'series_b' WHEN '5-LOW' THEN 'grant' ELSE 'undisclosed' END",
            "amount_usd": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
            "amount_as_published": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '$' || CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS STRING) || '00K' END",
            "currency": "'USD'",
            "announced_at": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END",
            "lead_investor": "CASE WHEN o_orderkey % 3 = 0 THEN 'Investor ' || CAST(o_orderkey % 50 AS STRING) END",
            "source_url": "'https://news.example.com/' || CAST(o_orderkey AS STRING)",
            "confidence": "(30 + (o_orderkey % 8) * 10) / CAST(100 AS DOUBLE)",
        },
    ),
    "snapshots": (
        "orders",
        {
            "snapshot_id": "o_orderkey",
            "candidate_id": "o_custkey",
            "calculated_at": "CAST(o_orderdate AS TIMESTAMP)",
            "state": "CASE WHEN o_orderkey % 13 = 0 THEN 'STALE' WHEN o_orderkey % 17 = 0 THEN 'REJECT' "
            "WHEN o_orderstatus = 'F' THEN 'HOT' WHEN o_orderstatus = 'O' THEN 'QUALIFIED' ELSE 'RADAR' END",
            "workflow_state": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'IN_REVIEW' ELSE 'NEW' END",
            "outreach_score": "o_totalprice / 5000",
            "radar_score": "o_totalprice / 6000",
            "confidence": "CAST(o_orderkey % 100 AS DOUBLE)",
            "risk": "CAST(o_orderkey % 60 AS DOUBLE)",
            "rule_version": "'v1.0+' || CAST(o_orderkey % 3 AS STRING)",
        },
    ),
    "candidates": (
        "customer",
        {
            "candidate_id": "c_custkey",
            "canonical_name": "c_name",
            "slug": "lower(replace(c_name, '#', '-'))",
            "organization_id": "c_nationkey",
            "stack_family": "lower(c_mktsegment)",
            "stage": _STAGES.format(x="c_custkey"),
            "layer": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'L2' END",
            "first_seen_at": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 500)",
            "last_verified_at": "CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END",
        },
    ),
    "assessments": (
        "customer",
        {
            "candidate_id": "c_custkey",
            "intent_label": _LABELS.format(x="c_custkey"),
            "total_score": "CAST(c_custkey % 101 AS DOUBLE)",
            "nation_key": "c_nationkey",
            "confidence": "CAST(c_custkey % 10 AS DOUBLE) / 10",
        },
    ),
    "users": (
        "events",
        {
            "candidate_id": "user_id",
            "stage": _STAGES.format(x="user_id"),
            "label": _LABELS.format(x="user_id"),
            "has_domain": "user_id % 2 = 0",
            "has_repo": "user_id % 3 = 0",
            "has_social": "user_id % 5 = 0",
            "verified_genesis": "user_id % 4 = 0",
            "has_fingerprint": "user_id % 2 = 0",
            "advancing_liveness": "user_id % 8 = 0",
            "has_rpc": "user_id % 3 <> 1",
            "has_testnet": "user_id % 6 = 0",
            "registry_pr_opened_at": "CASE WHEN user_id % 4 = 1 THEN TIMESTAMP '2024-01-02 00:00:00' END",
            "registry_merged_at": "CASE WHEN user_id % 9 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END",
            "mainnet_live_at": "CASE WHEN user_id % 7 >= 5 THEN TIMESTAMP '2023-11-05 00:00:00' END",
            "mainnet_announced_for": "CASE WHEN user_id % 7 = 4 THEN TIMESTAMP '2024-06-01 00:00:00' END",
            "testnet_announced_at": "CASE WHEN user_id % 7 = 2 THEN TIMESTAMP '2024-01-03 00:00:00' END",
            "fit": "CAST((user_id * 7) % 100 AS DOUBLE)",
            "risk": "CAST((user_id * 13) % 60 AS DOUBLE)",
            "hard_blocked": "user_id % 29 = 0",
        },
    ),
    "contacts": (
        "supplier",
        {
            "contact_id": "s_suppkey",
            "org_id": "s_nationkey",
            "candidate_id": "s_suppkey",
            "channel_value": "' Team-' || CAST(s_suppkey % 60 AS STRING) || '@Example.com '",
            "suppressed": "s_acctbal < 0",
            "last_verified_at": "TIMESTAMP '2023-09-01 00:00:00' + INTERVAL '1' DAY * (s_suppkey % 150)",
        },
    ),
    "claims_by_supplier": (
        "lineitem",
        {
            "caip2": "'eip155:' || CAST(l_partkey AS STRING)",
            "organization_id": "l_suppkey",
            "candidate_id": "CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey AS STRING)",
            "network_id": "CAST(l_suppkey % 40 AS STRING) || '-' || CAST(l_partkey % 50 AS STRING)",
            "evidence_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
            "observed_at": "CAST(l_shipdate AS TIMESTAMP)",
            "human_chain_id": "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_partkey % 50 + CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS STRING) END",
            "genesis_fingerprint": "CASE WHEN l_quantity > 25 THEN '0xg' || CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS STRING) END",
        },
    ),
}

# The fixed register of the five event types that stand for sources.
REGISTER_ROWS = (
    ("view", "registry", "A", 365, False),
    ("click", "code_search", "B", 20, False),
    ("error", "social", "C", 10, True),
    ("purchase", "careers", "B", 15, False),
    ("podcast", "news", "C", 30, False),
)
REGISTER_SQL = "register AS (SELECT * FROM (VALUES {}) t(source_id, family, tier, retention_days, kill_switch))".format(
    ", ".join(f"('{s}', '{f}', '{t}', {d}, {str(k).upper()})" for s, f, t, d, k in REGISTER_ROWS)
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def role(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, cols = ROLES[name]
    df = table(spark, sf, source).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
    if name == "users":
        df = df.distinct()
    if name == "evidence":
        df = df.withColumn("content_hash", F.sha2(F.col("payload"), 256))
    return df


def register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(REGISTER_ROWS),
        "source_id string, family string, tier string, retention_days int, kill_switch boolean",
    )


def cte(*names: str) -> str:
    """``WITH`` clause that gives DuckDB the same roles."""
    parts = []
    for n in names:
        if n == "register":
            parts.append(REGISTER_SQL)
            continue
        source, cols = ROLES[n]
        sel = ", ".join(f"{e} AS {c}" for c, e in cols.items())
        if n == "evidence":
            sel += ", sha256(props) AS content_hash, '60m:' || CAST(CAST(floor(epoch(ts) / 3600) AS BIGINT) AS STRING) AS observed_bucket"
        parts.append(f"{n} AS (SELECT {'DISTINCT ' if n == 'users' else ''}{sel} FROM {source})")
    return "WITH " + ",\n".join(parts) + "\n"


def t(c: str | Column) -> Column:
    """Timestamp as text, so that both engines show the same value."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def sql_t(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
