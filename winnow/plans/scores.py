"""Scoring queries over the evidence of users (R, flagship queue)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.ordered import top_n
from winnow.operators import score as S
from winnow.plans.registry import query
from winnow.plans.roles import AS_OF, LATER, cte, r, role, sql_t, t, table
from winnow.settings import DEFAULT

_HL = "CASE source_family " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in DEFAULT.half_life_days.items() if k != "default"
) + f" ELSE {DEFAULT.half_life_days['default']} END"
_TTL = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEFAULT.stale_days.items()) + " END"


def features_sql(as_of: str) -> str:
    age = f"((epoch(TIMESTAMP '{as_of}') - epoch(observed_at)) / 86400)"
    return f"""feats AS (SELECT candidate_id, max(observed_at) AS latest, min(observed_at) AS earliest, count(*) AS n,
  count(*) FILTER (WHERE {age} <= 14) AS n_recent,
  count(DISTINCT CASE WHEN {age} <= 14 THEN source_id END) AS recent_sources,
  coalesce(bool_or({age} <= 14 AND source_family IN ('careers', 'social')), FALSE) AS commercial,
  count(DISTINCT CASE WHEN source_family NOT IN ('', 'unknown') THEN source_family END) AS n_families,
  coalesce(bool_or(source_family = 'registry'), FALSE) AS reg_ev,
  max(10.0::DOUBLE * pow(0.5::DOUBLE, greatest({age}, 0)::DOUBLE / ({_HL})::DOUBLE)) AS fresh
  FROM evidence WHERE observed_at <= TIMESTAMP '{as_of}' GROUP BY 1)"""


def scored_sql(as_of: str) -> str:
    """Scores as nested selects over users and feats."""
    return f"""{features_sql(as_of)},
parts AS (SELECT u.*, f.*,
  CASE WHEN has_domain AND has_repo THEN 20 WHEN has_domain OR has_repo THEN 15 WHEN has_social THEN 8
       WHEN registry_pr_opened_at IS NOT NULL OR registry_merged_at IS NOT NULL THEN 4 ELSE 0 END AS c1,
  CASE WHEN registry_merged_at IS NOT NULL THEN 15 WHEN registry_pr_opened_at IS NOT NULL THEN 10 WHEN reg_ev THEN 8 ELSE 0 END AS c2,
  CASE WHEN advancing_liveness AND verified_genesis THEN 25 WHEN has_fingerprint AND verified_genesis THEN 20
       WHEN has_fingerprint THEN 15 WHEN has_rpc THEN 6 ELSE 0 END AS c3,
  CASE coalesce(n_families, 0) WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 15 END AS c4,
  CASE WHEN mainnet_live_at IS NOT NULL THEN 15 WHEN mainnet_announced_for IS NOT NULL THEN 12
       WHEN testnet_announced_at IS NOT NULL OR has_testnet THEN 10 WHEN stage <> 'S0_research_hint' THEN 6 ELSE 0 END AS c5,
  round(coalesce(fresh, 0), 2) AS c6,
  least(35, 7 * coalesce(n_recent, 0)) AS m1,
  CASE WHEN stage IN ('S2_public_testnet', 'S3_incentivized_testnet') THEN 30 WHEN stage = 'S4_mainnet_announced' THEN 35
       WHEN stage = 'S5_early_mainnet' THEN 25 ELSE 10 END AS m2,
  least(20, 5 * coalesce(recent_sources, 0)) AS m3,
  CASE WHEN coalesce(commercial, FALSE) THEN 15 ELSE 5 END AS m4
  FROM users u LEFT JOIN (SELECT candidate_id AS cid, * EXCLUDE (candidate_id) FROM feats) f ON u.candidate_id = f.cid),
totals AS (SELECT *, least(100, CAST(c1 + c2 + c3 + c4 + c5 AS DOUBLE) + c6) AS conf, CAST(least(100, m1 + m2 + m3 + m4) AS DOUBLE) AS mom FROM parts),
comp AS (SELECT *, greatest(0, least(100, 0.40::DOUBLE * mom + 0.35::DOUBLE * conf + 0.25::DOUBLE * fit)) AS radar,
  greatest(0, least(100, 0.45::DOUBLE * conf + 0.35::DOUBLE * fit + 0.20::DOUBLE * mom - 0.30::DOUBLE * risk)) AS outreach,
  (conf >= 65 AND (has_domain OR has_repo OR has_social) AND (coalesce(n_families, 0) >= 2 OR has_fingerprint) AND NOT hard_blocked) AS passed,
  (latest IS NULL OR (epoch(TIMESTAMP '{as_of}') - epoch(latest)) / 86400 > {_TTL}) AS stale FROM totals),
scored AS (SELECT *, CASE WHEN hard_blocked THEN 'REJECT' WHEN stale THEN 'STALE'
  WHEN passed AND conf >= 75 AND outreach >= 70 AND risk < 34 AND (stage IN ('S2_public_testnet', 'S3_incentivized_testnet', 'S4_mainnet_announced', 'S5_early_mainnet')
       OR label IN ('A1_explicit_intent', 'A2_active_regional_motion')) THEN 'HOT'
  WHEN passed AND conf >= 65 AND outreach >= 55 THEN 'QUALIFIED' ELSE 'RADAR' END AS state FROM comp)
"""


def _base(as_of: str) -> str:
    return cte("evidence", "users").rstrip() + ",\n" + scored_sql(as_of)


def _scored(spark, sf, as_of):
    return S.score_candidates(role(spark, sf, "users"), role(spark, sf, "evidence"), as_of)


@query(
    "ranked_queue",
    "L1 R4 R5 R6 R7 R8 R11 O1",
    cte("users").rstrip() + ",\nraw_" + cte("evidence").rstrip()[5:]
    + """,
evidence AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, content_hash, observed_bucket
  ORDER BY observed_at, external_id, content_hash) rn FROM raw_evidence) WHERE rn = 1),
"""
    + scored_sql(AS_OF)
    + """SELECT candidate_id, state, round(conf, 4) AS confidence, mom AS momentum, round(radar, 4) AS radar_score,
  round(outreach, 4) AS outreach_score, n AS evidence_count FROM scored
ORDER BY CASE state WHEN 'HOT' THEN 1 WHEN 'QUALIFIED' THEN 2 WHEN 'RADAR' THEN 3 WHEN 'STALE' THEN 4 ELSE 5 END, outreach DESC, candidate_id LIMIT 50""",
)
def _(spark, sf):
    """Ledger, features, scores and the top of the queue in one plan."""
    from winnow.operators.ledger import append_evidence

    ev = append_evidence(role(spark, sf, "evidence"), unique_external_ids=True)
    df = S.score_candidates(role(spark, sf, "users"), ev, AS_OF)
    priority = S.lookup({"HOT": 1, "QUALIFIED": 2, "RADAR": 3, "STALE": 4, "REJECT": 5}, F.col("state"), 6)
    return (
        df.orderBy(priority, F.col("outreach_score").desc(), "candidate_id")
        .limit(50)
        .select(
            "candidate_id", "state", r("confidence", 4).alias("confidence"), "momentum",
            r("radar_score", 4).alias("radar_score"), r("outreach_score", 4).alias("outreach_score"), "evidence_count",
        )
    )


@query(
    "independent_families",
    "R4",
    cte("evidence") + "SELECT DISTINCT candidate_id, source_family FROM evidence WHERE source_family NOT IN ('', 'unknown')",
)
def _(spark, sf):
    return S.source_families(role(spark, sf, "evidence"))


@query(
    "evidence_freshness",
    "R5",
    cte("evidence")
    + f"""SELECT candidate_id, source_family,
  round(10.0::DOUBLE * pow(0.5::DOUBLE, greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(max(observed_at))) / 86400, 0)::DOUBLE / ({_HL})::DOUBLE), 6) AS freshness
FROM evidence GROUP BY 1, 2""",
)
def _(spark, sf):
    df = S.family_freshness(role(spark, sf, "evidence"), AS_OF)
    return df.select("candidate_id", "source_family", r("freshness").alias("freshness"))


@query(
    "attribution_facts",
    "R3",
    cte("users")
    + """SELECT candidate_id, has_domain OR has_repo OR has_social AS officially_attributed,
  registry_pr_opened_at IS NOT NULL OR registry_merged_at IS NOT NULL AS has_registry_record,
  concat_ws('; ', CASE WHEN has_domain THEN 'official domain' END, CASE WHEN has_repo THEN 'official repository' END,
   CASE WHEN has_social THEN 'verified official social handle' END,
   CASE WHEN registry_pr_opened_at IS NOT NULL OR registry_merged_at IS NOT NULL THEN 'registry submission recorded' END,
   CASE WHEN NOT (has_domain OR has_repo OR has_social) THEN 'no official domain, repository or verified handle' END) AS reasons
FROM users""",
)
def _(spark, sf):
    df = S.attribution(role(spark, sf, "users"))
    return df.select("candidate_id", "officially_attributed", "has_registry_record", F.array_join("attribution_reasons", "; ").alias("reasons"))


@query(
    "confidence_parts",
    "R6 R3 R4 R5",
    _base(AS_OF)
    + """SELECT candidate_id, c1::DOUBLE AS c_attribution, c2::DOUBLE AS c_registry, c3::DOUBLE AS c_technical,
  c4::DOUBLE AS c_corroboration, c5::DOUBLE AS c_lifecycle, c6::DOUBLE AS c_freshness, round(conf, 4) AS confidence FROM scored""",
)
def _(spark, sf):
    cols = ["c_attribution", "c_registry", "c_technical", "c_corroboration", "c_lifecycle", "c_freshness"]
    return _scored(spark, sf, AS_OF).select("candidate_id", *cols, r("confidence", 4).alias("confidence"))


@query(
    "momentum_parts",
    "R7",
    _base(AS_OF)
    + "SELECT candidate_id, m1::DOUBLE AS m_velocity, m2::DOUBLE AS m_stage, m3::DOUBLE AS m_sources, m4::DOUBLE AS m_commercial, mom AS momentum FROM scored",
)
def _(spark, sf):
    return _scored(spark, sf, AS_OF).select("candidate_id", "m_velocity", "m_stage", "m_sources", "m_commercial", "momentum")


@query(
    "composite_scores",
    "R8",
    _base(AS_OF) + "SELECT candidate_id, round(radar, 4) AS radar_score, round(outreach, 4) AS outreach_score FROM scored",
)
def _(spark, sf):
    return _scored(spark, sf, AS_OF).select("candidate_id", r("radar_score", 4).alias("radar_score"), r("outreach_score", 4).alias("outreach_score"))


@query(
    "outreach_gate",
    "R9",
    _base(AS_OF)
    + """SELECT candidate_id, passed AS gate_passed, concat_ws('; ', CASE WHEN conf < 65 THEN 'confidence below minimum' END,
  CASE WHEN NOT (has_domain OR has_repo OR has_social) THEN 'no official attribution' END,
  CASE WHEN NOT (coalesce(n_families, 0) >= 2 OR has_fingerprint) THEN 'needs technical verification or independent source families' END,
  CASE WHEN hard_blocked THEN 'hard blocked by policy' END) AS gate_failures FROM scored""",
)
def _(spark, sf):
    return _scored(spark, sf, AS_OF).select("candidate_id", "gate_passed", F.array_join("gate_failures", "; ").alias("gate_failures"))


@query(
    "stale_candidates",
    "R10 T8",
    _base(LATER)
    + f"SELECT candidate_id, round((epoch(TIMESTAMP '{LATER}') - epoch(latest)) / 86400, 6) AS evidence_age_days, stale FROM scored",
)
def _(spark, sf):
    return _scored(spark, sf, LATER).select("candidate_id", r("evidence_age_days").alias("evidence_age_days"), "stale")


@query("candidate_states", "R11", _base(LATER) + "SELECT candidate_id, state, state = 'RADAR' AND radar < 45 AS below_watch FROM scored")
def _(spark, sf):
    return _scored(spark, sf, LATER).select("candidate_id", "state", "below_watch")


_PREV = """, prev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY calculated_at DESC, snapshot_id DESC) rn FROM snapshots) WHERE rn = 1)
"""


@query(
    "score_snapshots",
    "R12 S5",
    cte("evidence", "users", "snapshots").rstrip() + ",\n" + scored_sql(AS_OF) + _PREV
    + f"""SELECT s.candidate_id, s.state, coalesce(p.workflow_state, 'NEW') AS workflow_state, round(conf, 4) AS confidence,
  round(outreach, 4) AS outreach_score, '{DEFAULT.version}' AS rule_version, '{AS_OF}' AS calculated_at
FROM scored s LEFT JOIN prev p ON s.candidate_id = p.candidate_id""",
)
def _(spark, sf):
    prev = top_n(role(spark, sf, "snapshots"), ["candidate_id"], [F.col("calculated_at").desc(), F.col("snapshot_id").desc()])
    df = S.score_candidates(role(spark, sf, "users"), role(spark, sf, "evidence"), AS_OF, prev)
    return df.select(
        "candidate_id", "state", "workflow_state", r("confidence", 4).alias("confidence"),
        r("outreach_score", 4).alias("outreach_score"), "rule_version", t("calculated_at").alias("calculated_at"),
    )


@query(
    "score_reconciliation",
    "R13 T8",
    cte("evidence", "users", "snapshots").rstrip() + ",\n" + scored_sql(LATER) + _PREV
    + """SELECT s.candidate_id, p.state AS old_state, s.state AS new_state,
  p.state IS DISTINCT FROM s.state OR abs(coalesce(p.outreach_score, -1) - s.outreach) > 1e-9 AS diverges
FROM scored s LEFT JOIN prev p ON s.candidate_id = p.candidate_id WHERE p.state IS NULL OR p.state <> 'REJECT'""",
)
def _(spark, sf):
    prev = top_n(role(spark, sf, "snapshots"), ["candidate_id"], [F.col("calculated_at").desc(), F.col("snapshot_id").desc()])
    df = S.reconcile(role(spark, sf, "users"), role(spark, sf, "evidence"), prev, LATER, skip_rejected=True)
    return df.select("candidate_id", "old_state", "new_state", "diverges")


def _observations(spark, sf):
    """Events as observations: the props number picks which lifecycle claim a row makes."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = list(S.FIRST_WINS) + [S.LAST_PRESENT_WINS] + list(S.SIGHT_CLAIMS)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    at = F.date_format(F.col("ts").cast("timestamp") - F.expr("interval 1 day") * (k % 7), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.when(k % 10 == 3, F.lit(None)).otherwise(at)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("candidate_id"),
        F.col("event_id").alias("evidence_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.create_map(name, value).alias("claims"),
    )


_NAMES = list(S.FIRST_WINS) + [S.LAST_PRESENT_WINS] + list(S.SIGHT_CLAIMS)
_OBS_SQL = f"""WITH o AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
obs AS (SELECT user_id AS candidate_id, event_id, ts, k % {len(_NAMES)} AS claim,
  CASE WHEN k % 10 = 3 THEN NULL ELSE date_trunc('second', ts - INTERVAL 1 DAY * (k % 7)) END AS v FROM o)
"""


def _first_sql(k: str) -> str:
    i = _NAMES.index(k)
    return f"arg_min(v, row(ts, event_id)) FILTER (WHERE claim = {i} AND v IS NOT NULL)"


@query(
    "lifecycle_timestamps",
    "R1 J4",
    _OBS_SQL
    + ", c AS (SELECT candidate_id, "
    + ", ".join(f"{_first_sql(k)} AS {k}" for k in S.FIRST_WINS)
    + f", max(row(ts, event_id, v)) FILTER (WHERE claim = {_NAMES.index(S.LAST_PRESENT_WINS)}) AS ann, "
    + ", ".join(f"min(v) FILTER (WHERE claim = {_NAMES.index(k)}) AS s_{k}" for k in S.SIGHT_CLAIMS)
    + ", arg_min(CASE WHEN v IS NOT NULL AND claim IN ("
    + ", ".join(str(_NAMES.index(k)) for k in S.INITIAL_SIGHT)
    + ") THEN v ELSE ts END, row(ts, event_id)) AS ini FROM obs GROUP BY 1)\nSELECT candidate_id, "
    + ", ".join(f"{sql_t(k)} AS {k}" for k in S.FIRST_WINS)
    + f", {sql_t('ann[3]')} AS mainnet_announced_for, "
    + sql_t("least(ini, s_published_at, s_first_seen_at, s_created_at, repo_created_at, first_commit_at, domain_first_seen_at, registry_pr_opened_at, testnet_announced_at)")
    + " AS first_seen_at FROM c",
)
def _(spark, sf):
    df = S.lifecycle_timestamps(_observations(spark, sf))
    cols = [*S.FIRST_WINS, "mainnet_announced_for", "first_seen_at"]
    return df.select("candidate_id", *[t(c).alias(c) for c in cols])


@query(
    "lifecycle_stages",
    "R2",
    cte("users")
    + f"""SELECT candidate_id, CASE WHEN mainnet_live_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY THEN 'S5_early_mainnet'
  WHEN mainnet_live_at IS NOT NULL THEN 'S6_established_archived' WHEN mainnet_announced_for IS NOT NULL THEN 'S4_mainnet_announced'
  WHEN has_social THEN 'S3_incentivized_testnet' WHEN testnet_announced_at IS NOT NULL OR has_testnet THEN 'S2_public_testnet'
  WHEN registry_pr_opened_at IS NOT NULL OR has_repo THEN 'S1_devnet_prototype' ELSE 'S0_research_hint' END AS stage FROM users""",
)
def _(spark, sf):
    u = role(spark, sf, "users").withColumn("has_incentive", F.col("has_social"))
    u = u.withColumn("has_public_testnet", F.col("has_testnet")).withColumn("has_devnet", F.col("has_repo"))
    u = u.withColumn("repo_created_at", F.lit(None).cast("timestamp"))
    return S.lifecycle_stage(u, AS_OF).select("candidate_id", "stage")
