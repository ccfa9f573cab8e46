"""Queues, top-k windows, histories and reports (W, O, A, J13, J14, J18–J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.ordered import top_n
from winnow.operators import queues as Q
from winnow.plans.registry import query
from winnow.plans.roles import AS_OF, LATER, ORDERS_AS_OF, cte, r, role, sql_t, t, table

_RANK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) rn FROM {f}) WHERE rn <= {n}"
_CURRENT = "cur AS (" + _RANK.format(k="candidate_id", o="calculated_at DESC, snapshot_id DESC", f="snapshots", n=1) + ")"
_TOTALS = (
    "tot AS (SELECT candidate_id, coalesce(sum(amount_usd), 0) AS total_funding_usd, max(announced_at) AS latest_funding_at, "
    "count(*) AS rounds_count FROM rounds GROUP BY 1)"
)
_PRIORITY = "CASE state WHEN 'HOT' THEN 1 WHEN 'QUALIFIED' THEN 2 WHEN 'RADAR' THEN 3 WHEN 'STALE' THEN 4 WHEN 'REJECT' THEN 5 ELSE 6 END"
_ALL = cte("candidates", "snapshots", "assessments", "rounds").rstrip() + ",\n" + _CURRENT + ",\n" + _TOTALS + """,
joined AS (SELECT c.*, s.state, s.workflow_state, s.outreach_score, s.radar_score, a.intent_label, a.total_score,
  t.total_funding_usd, t.latest_funding_at, t.rounds_count
  FROM candidates c LEFT JOIN cur s ON c.candidate_id = s.candidate_id LEFT JOIN assessments a ON c.candidate_id = a.candidate_id
  LEFT JOIN tot t ON c.candidate_id = t.candidate_id)
"""
_ORDER = (
    f"{_PRIORITY}, latest_funding_at DESC NULLS LAST, outreach_score DESC NULLS LAST, "
    "round(coalesce(total_funding_usd, 0), 2) DESC, first_seen_at DESC, candidate_id"
)


def _parts(spark, sf):
    return tuple(role(spark, sf, n) for n in ("candidates", "snapshots", "assessments", "rounds"))


@query(
    "latest_per_channel",
    "W1",
    cte("activity") + "SELECT candidate_id, channel, snapshot_id FROM ("
    + _RANK.format(k="candidate_id, channel", o="observed_at DESC, snapshot_id DESC", f="activity", n=1) + ")",
)
def _(spark, sf):
    return Q.latest_per_channel(role(spark, sf, "activity")).select("candidate_id", "channel", "snapshot_id")


@query(
    "latest_funding_round",
    "W4",
    cte("rounds") + f"SELECT candidate_id, round_id, round_type, {sql_t('announced_at')} AS announced_at FROM ("
    + _RANK.format(k="candidate_id", o="announced_at DESC NULLS LAST, round_id", f="rounds", n=1) + ")",
)
def _(spark, sf):
    return Q.latest_round(role(spark, sf, "rounds")).select("candidate_id", "round_id", "round_type", t("announced_at").alias("announced_at"))


@query(
    "newest_evidence_per_candidate",
    "W5",
    cte("evidence") + "SELECT candidate_id, evidence_id, CAST(rn AS INT) AS position FROM ("
    + _RANK.format(k="candidate_id", o="observed_at DESC, evidence_id", f="evidence", n=15) + ")",
)
def _(spark, sf):
    return Q.top_evidence(role(spark, sf, "evidence")).select("candidate_id", "evidence_id", "position")


@query(
    "score_history",
    "W6",
    cte("snapshots") + "SELECT candidate_id, snapshot_id, state, row_number() OVER (PARTITION BY candidate_id ORDER BY calculated_at DESC, snapshot_id DESC) = 1 AS is_current FROM snapshots",
)
def _(spark, sf):
    return Q.score_history(role(spark, sf, "snapshots")).select("candidate_id", "snapshot_id", "state", "is_current")


@query(
    "current_scores",
    "W7",
    cte("snapshots") + "SELECT candidate_id, snapshot_id, state, outreach_score FROM (" + _RANK.format(k="candidate_id", o="calculated_at DESC, snapshot_id DESC", f="snapshots", n=1) + ")",
)
def _(spark, sf):
    return Q.current_scores(role(spark, sf, "snapshots")).select("candidate_id", "snapshot_id", "state", "outreach_score")


@query(
    "hot_transitions",
    "W8",
    cte("snapshots") + f"""SELECT candidate_id, snapshot_id, prev AS prev_state, {sql_t('calculated_at')} AS calculated_at FROM
  (SELECT *, lag(state) OVER (PARTITION BY candidate_id ORDER BY calculated_at, snapshot_id) AS prev FROM snapshots)
WHERE state = 'HOT' AND prev IS DISTINCT FROM 'HOT'""",
)
def _(spark, sf):
    return Q.hot_transitions(role(spark, sf, "snapshots")).select("candidate_id", "snapshot_id", "prev_state", t("calculated_at").alias("calculated_at"))


@query(
    "verification_trail",
    "W9",
    cte("probes") + "SELECT candidate_id, probe_id, CAST(rn AS INT) AS position FROM (" + _RANK.format(k="candidate_id", o="observed_at DESC, probe_id DESC", f="probes", n=50) + ")",
)
def _(spark, sf):
    return Q.verification_trail(role(spark, sf, "probes")).select("candidate_id", "probe_id", "position")


@query(
    "candidate_queue",
    "O1 J18 A5 W7",
    _ALL + f"""SELECT candidate_id, state, {sql_t('latest_funding_at')} AS latest_funding_at, outreach_score,
  round(total_funding_usd, 2) AS total_funding_usd FROM joined ORDER BY {_ORDER} LIMIT 50""",
)
def _(spark, sf):
    df = Q.candidate_queue(*_parts(spark, sf), limit=50)
    return df.select("candidate_id", "state", t("latest_funding_at").alias("latest_funding_at"), "outreach_score", r("total_funding_usd", 2).alias("total_funding_usd"))


@query(
    "candidate_queue_filtered",
    "O1 J19 N21",
    _ALL + f"""SELECT candidate_id, state, intent_label FROM joined WHERE stack_family = 'building' AND last_verified_at IS NOT NULL
  AND (lower(canonical_name) LIKE '%00%' OR slug LIKE '%00%')
  AND candidate_id IN (SELECT candidate_id FROM rounds WHERE announced_at >= TIMESTAMP '1998-01-01 00:00:00' AND announced_at <= TIMESTAMP '{ORDERS_AS_OF}' AND amount_usd >= 250000)
ORDER BY {_ORDER} LIMIT 25 OFFSET 5""",
)
def _(spark, sf):
    funding = {"since": "1998-01-01 00:00:00", "until": ORDERS_AS_OF, "min_amount": 250000.0}
    df = Q.candidate_queue(*_parts(spark, sf), limit=25, offset=5, stack_family="building", search="00", verified_only=True, funding=funding)
    return df.select("candidate_id", "state", "intent_label")


@query(
    "candidate_pages",
    "O2",
    cte("candidates") + "SELECT candidate_id, canonical_name FROM candidates ORDER BY first_seen_at DESC, candidate_id LIMIT 20 OFFSET 40",
)
def _(spark, sf):
    return Q.page(role(spark, sf, "candidates"), [F.col("first_seen_at").desc(), F.col("candidate_id")], 3, 20).select("candidate_id", "canonical_name")


@query(
    "enrichment_queue",
    "O3",
    _ALL + "SELECT candidate_id, state, outreach_score FROM joined WHERE state IN ('HOT', 'QUALIFIED', 'RADAR') ORDER BY outreach_score DESC, candidate_id LIMIT 25",
)
def _(spark, sf):
    return Q.enrichment_queue(role(spark, sf, "candidates"), role(spark, sf, "snapshots")).select("candidate_id", "state", "outreach_score")


def _hourly_probes(spark, sf):
    """Probes per endpoint and hour, so that many endpoints have a single observation."""
    p = role(spark, sf, "probes")
    return p.withColumn("endpoint_hash", F.concat("endpoint_hash", F.lit("-"), F.date_format("observed_at", "dd-HH")))


@query(
    "recheck_queue",
    "O4",
    cte("probes") + f""", h AS (SELECT *, endpoint_hash || '-' || strftime(observed_at, '%d-%H') AS eh FROM probes)
SELECT eh AS endpoint_hash, probe_id FROM (SELECT *, count(*) OVER (PARTITION BY eh) AS n FROM h)
WHERE n = 1 AND probe_round = 1 AND success AND observed_at <= TIMESTAMP '{AS_OF}' - INTERVAL 60 SECOND ORDER BY observed_at, eh LIMIT 50""",
)
def _(spark, sf):
    return Q.recheck_queue(_hourly_probes(spark, sf), AS_OF).select("endpoint_hash", "probe_id")


def _tasks(spark, sf):
    return role(spark, sf, "snapshots").select(
        F.col("snapshot_id").alias("task_id"),
        F.when(F.col("state") == "HOT", "chain_id_collision").when(F.col("state") == "RADAR", "weak_name_match").otherwise("chain_id_changed").alias("task_type"),
        F.when(F.col("workflow_state") == "NEW", "open").otherwise("resolved").alias("status"),
        F.col("calculated_at").alias("created_at"),
    )


_TASKS = """, tasks AS (SELECT snapshot_id AS task_id, CASE state WHEN 'HOT' THEN 'chain_id_collision' WHEN 'RADAR' THEN 'weak_name_match' ELSE 'chain_id_changed' END AS task_type,
  CASE workflow_state WHEN 'NEW' THEN 'open' ELSE 'resolved' END AS status, calculated_at AS created_at FROM snapshots)
"""


@query(
    "review_task_listing",
    "O5",
    cte("snapshots") + _TASKS + f"SELECT task_id, task_type, {sql_t('created_at')} AS created_at FROM tasks WHERE status = 'open' AND task_type = 'weak_name_match' ORDER BY created_at DESC, task_id LIMIT 50",
)
def _(spark, sf):
    return Q.list_review_tasks(_tasks(spark, sf), task_type="weak_name_match").select("task_id", "task_type", t("created_at").alias("created_at"))


@query(
    "alert_listing",
    "O5 N21",
    cte("snapshots") + f"SELECT snapshot_id AS alert_id, strftime(calculated_at + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS dispatched_at_display FROM snapshots WHERE state = 'HOT' ORDER BY calculated_at DESC, snapshot_id LIMIT 50",
)
def _(spark, sf):
    alerts = role(spark, sf, "snapshots").filter("state = 'HOT'").select(F.col("snapshot_id").alias("alert_id"), F.col("calculated_at").alias("dispatched_at"))
    return Q.list_alerts(alerts).select("alert_id", "dispatched_at_display")


@query(
    "rounds_of_candidate",
    "O6",
    cte("rounds") + f"SELECT round_id, {sql_t('announced_at')} AS announced_at FROM rounds WHERE candidate_id = 77",
)
def _(spark, sf):
    return Q.list_rounds(role(spark, sf, "rounds"), 77).select("round_id", t("announced_at").alias("announced_at"))


@query("open_tasks_by_type", "A6", cte("snapshots") + _TASKS + "SELECT task_type, count(*) AS n FROM tasks WHERE status = 'open' GROUP BY 1")
def _(spark, sf):
    return Q.open_tasks_by_type(_tasks(spark, sf))


@query(
    "funnel",
    "A1",
    _ALL + """SELECT 'pipeline_state' AS dimension, state AS value, count(*) AS n FROM cur GROUP BY 2 UNION ALL
SELECT 'workflow_state', workflow_state, count(*) FROM cur GROUP BY 2 UNION ALL
SELECT 'intent_label', intent_label, count(*) FROM assessments GROUP BY 2 UNION ALL
SELECT 'stack_family', stack_family, count(*) FROM candidates GROUP BY 2""",
)
def _(spark, sf):
    c, s, a, _rounds = _parts(spark, sf)
    return Q.funnel(c, s, a)


@query(
    "funnel_history",
    "A1",
    _ALL + """SELECT 'pipeline_state' AS dimension, state AS value, count(*) AS n FROM snapshots GROUP BY 2 UNION ALL
SELECT 'workflow_state', workflow_state, count(*) FROM snapshots GROUP BY 2 UNION ALL
SELECT 'intent_label', intent_label, count(*) FROM assessments GROUP BY 2 UNION ALL
SELECT 'stack_family', stack_family, count(*) FROM candidates GROUP BY 2""",
)
def _(spark, sf):
    c, s, a, _rounds = _parts(spark, sf)
    return Q.funnel(c, s, a, history=True)


def _geo(spark, sf):
    """Assessments with the candidate's nation as country and its region."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(
        F.col("n_nationkey").alias("nation_key"),
        F.array(F.initcap("n_name")).alias("countries"),
        F.array("r_name", F.concat(F.lit("zone "), F.col("n_regionkey").cast("string"))).alias("regions"),
    )
    return role(spark, sf, "assessments").join(n, "nation_key")


_GEO = """, geo AS (SELECT a.*, upper(n_name[1]) || lower(n_name[2:]) AS country, r_name, n_regionkey FROM assessments a
  JOIN nation ON nation_key = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(
    "region_matrix",
    "A2",
    cte("assessments") + """, geo AS (SELECT a.*, n_name, r_name, n_regionkey FROM assessments a JOIN nation ON nation_key = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'country' AS kind, lower(n_name) AS name, count(*) AS n FROM geo GROUP BY 2 UNION ALL
SELECT 'region', lower(r_name), count(*) FROM geo GROUP BY 2 UNION ALL SELECT 'region', 'zone ' || CAST(n_regionkey AS STRING), count(*) FROM geo GROUP BY 2""",
)
def _(spark, sf):
    return Q.region_matrix(_geo(spark, sf)).withColumn("name", F.lower("name"))


@query(
    "calibration_report",
    "A4",
    cte("snapshots") + f""", w AS (SELECT * FROM snapshots WHERE calculated_at <= TIMESTAMP '{ORDERS_AS_OF}' AND calculated_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY)
SELECT 'state' AS section, state AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM w GROUP BY 2 UNION ALL
SELECT 'rule_version', rule_version, count(*), NULL FROM w GROUP BY 2 UNION ALL
SELECT 'average', 'confidence', count(*), round(coalesce(avg(confidence), 0), 6) FROM w UNION ALL
SELECT 'average', 'outreach_score', count(*), round(coalesce(avg(outreach_score), 0), 6) FROM w UNION ALL
SELECT 'average', 'risk', count(*), round(coalesce(avg(risk), 0), 6) FROM w UNION ALL
SELECT 'config_changed', 'rule_versions', count(DISTINCT rule_version), CASE WHEN count(DISTINCT rule_version) > 1 THEN 1.0 ELSE 0.0 END FROM w""",
)
def _(spark, sf):
    return Q.calibration_report(role(spark, sf, "snapshots"), ORDERS_AS_OF).withColumn("value", r("value"))


@query(
    "funding_totals",
    "A5",
    cte("rounds").rstrip() + ",\n" + _TOTALS + f"SELECT candidate_id, round(total_funding_usd, 2) AS total_funding_usd, {sql_t('latest_funding_at')} AS latest_funding_at, rounds_count FROM tot",
)
def _(spark, sf):
    df = Q.funding_totals(role(spark, sf, "rounds"))
    return df.select("candidate_id", r("total_funding_usd", 2).alias("total_funding_usd"), t("latest_funding_at").alias("latest_funding_at"), "rounds_count")


@query("candidate_count", "A7", _ALL + "SELECT count(DISTINCT candidate_id) AS n_candidates FROM joined WHERE state = 'HOT' AND intent_label = 'A1_explicit_intent'")
def _(spark, sf):
    return Q.count_candidates(*_parts(spark, sf), state="HOT", label="A1_explicit_intent")


@query(
    "dashboard_kpis",
    "A8",
    _ALL + """SELECT (SELECT count(*) FROM cur WHERE state = 'HOT') AS hot, (SELECT count(*) FROM cur WHERE state = 'QUALIFIED') AS qualified,
 (SELECT count(*) FROM cur WHERE state IN ('RADAR', 'STALE')) AS radar_stale,
 (SELECT count(*) FROM assessments WHERE intent_label LIKE 'A1%' OR intent_label LIKE 'A2%') AS explicit_intent""",
)
def _(spark, sf):
    return Q.kpis(role(spark, sf, "snapshots"), role(spark, sf, "assessments"))


def networks(spark, sf):
    """Networks of customers: about half have one, some with a chain id."""
    c = table(spark, sf, "customer").filter("c_custkey % 2 = 0")
    return c.select(
        F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("network_id"),
        F.col("c_custkey").alias("candidate_id"),
        F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 900).cast("string")).alias("human_chain_id"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("eip155:"), (F.col("c_custkey") % 900).cast("string"))).alias("caip2"),
    )


NETWORKS = """nets AS (SELECT 'n' || CAST(c_custkey AS STRING) AS network_id, c_custkey AS candidate_id,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 900 AS STRING) END AS human_chain_id,
  CASE WHEN c_custkey % 5 <> 0 THEN 'eip155:' || CAST(c_custkey % 900 AS STRING) END AS caip2 FROM customer WHERE c_custkey % 2 = 0)"""


def network_urls(spark, sf):
    n = networks(spark, sf)
    return n.filter("candidate_id % 3 <> 0").select(
        "network_id", "candidate_id", F.lit("rpc").alias("kind"), F.concat(F.lit("https://rpc."), F.col("candidate_id").cast("string"), F.lit(".example.com/v2")).alias("url")
    )


@query(
    "activity_points",
    "A9",
    cte("candidates", "evidence") + f""", {NETWORKS}, pts AS (SELECT c.candidate_id, least(2, (SELECT count(*) FROM evidence e WHERE e.candidate_id = c.candidate_id))
 + least(1, (SELECT count(*) FROM nets n WHERE n.candidate_id = c.candidate_id))
 + CASE WHEN c.candidate_id % 2 = 0 AND c.candidate_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN last_verified_at IS NOT NULL THEN 1 ELSE 0 END AS p FROM candidates c)
SELECT candidate_id, CAST(p AS BIGINT) AS activity_points, CASE WHEN p >= 4 THEN 'high' WHEN p = 3 THEN 'med' WHEN p = 2 THEN 'low' WHEN p = 1 THEN 'min' ELSE 'none' END AS activity_band FROM pts""",
)
def _(spark, sf):
    df = Q.activity_points(role(spark, sf, "candidates"), role(spark, sf, "evidence"), networks(spark, sf), network_urls(spark, sf))
    return df.select("candidate_id", "activity_points", "activity_band")


@query(
    "money_bands",
    "A10",
    cte("rounds").rstrip() + ",\n" + _TOTALS + """SELECT candidate_id, CASE WHEN total_funding_usd >= 1e9 THEN printf('$%.1fB', total_funding_usd / 1e9) WHEN total_funding_usd >= 1e6 THEN printf('$%.1fM', total_funding_usd / 1e6)
 WHEN total_funding_usd > 0 THEN printf('$%.0fK', total_funding_usd / 1e3) WHEN rounds_count > 0 THEN 'undisc.' ELSE '—' END AS raised FROM tot""",
)
def _(spark, sf):
    df = Q.funding_totals(role(spark, sf, "rounds"))
    return df.select("candidate_id", Q.format_usd(F.col("total_funding_usd"), F.col("rounds_count")).alias("raised"))


@query(
    "probe_outcomes",
    "A11",
    cte("probes") + "SELECT CAST(CAST(observed_at AS DATE) AS STRING) AS day, CASE WHEN success THEN 'success' ELSE coalesce(failure_class, 'unreachable') END AS outcome, count(*) AS n FROM probes GROUP BY 1, 2",
)
def _(spark, sf):
    return Q.probe_outcomes(role(spark, sf, "probes")).withColumn("day", F.col("day").cast("string"))


@query(
    "enrichment_totals",
    "A12",
    cte("rounds") + "SELECT count(DISTINCT candidate_id) AS chains, count(*) AS rounds, round(coalesce(sum(amount_usd), 0), 2) AS total_usd FROM rounds",
)
def _(spark, sf):
    return Q.enrichment_totals(role(spark, sf, "rounds")).withColumn("total_usd", r("total_usd", 2))


def investors(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 3 = 0 OR o_orderkey % 4 = 0")
    pos = F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int"))
    return o.select(F.col("o_orderkey").alias("round_id"), F.col("o_custkey").alias("candidate_id"), F.explode(pos).alias("position")).withColumn(
        "investor", F.concat(F.lit("Investor "), ((F.col("round_id") + F.col("position")) % 50).cast("string"))
    )


INVESTORS = """invs AS (SELECT round_id, candidate_id, CAST(p AS INT) AS position, 'Investor ' || CAST((round_id + p) % 50 AS STRING) AS investor FROM
  (SELECT o_orderkey AS round_id, o_custkey AS candidate_id, unnest(range(0, o_orderkey % 3 + 1)) AS p FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0))"""


@query(
    "list_view",
    "A13 A5 W4 J8",
    _ALL.rstrip() + f""",
{NETWORKS}, {INVESTORS}, q AS (SELECT * FROM joined ORDER BY {_ORDER} LIMIT 50),
lr AS ({_RANK.format(k='candidate_id', o='announced_at DESC NULLS LAST, round_id', f='rounds', n=1)})
SELECT q.candidate_id, q.canonical_name[1:24] AS name, coalesce(n.human_chain_id, '—') AS chain_id, upper(stack_family) AS stack, split_part(intent_label, '_', 1) AS label,
 CASE WHEN total_funding_usd >= 1e9 THEN printf('$%.1fB', total_funding_usd / 1e9) WHEN total_funding_usd >= 1e6 THEN printf('$%.1fM', total_funding_usd / 1e6)
  WHEN total_funding_usd > 0 THEN printf('$%.0fK', total_funding_usd / 1e3) WHEN rounds_count > 0 THEN 'undisc.' ELSE '—' END AS raised,
 coalesce(strftime(lr.announced_at, '%Y-%m-%d'), '—') AS raised_on,
 coalesce(lr.lead_investor, (SELECT investor FROM invs WHERE position = 0 AND round_id = (SELECT min(round_id) FROM rounds r2 WHERE r2.candidate_id = q.candidate_id)), '—') AS lead,
 coalesce(outreach_score, 0) AS outreach, coalesce(radar_score, 0) AS radar, coalesce(state, '—') AS state
FROM q LEFT JOIN nets n ON q.candidate_id = n.candidate_id LEFT JOIN lr ON q.candidate_id = lr.candidate_id""",
)
def _(spark, sf):
    q = Q.candidate_queue(*_parts(spark, sf), limit=50)
    return Q.list_view(q, networks(spark, sf), role(spark, sf, "rounds"), investors(spark, sf))


def orgs(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").alias("org_id"),
        F.col("n_name").alias("display_name"),
        F.concat(F.col("n_name"), F.lit(" Ltd")).alias("legal_name"),
        F.array(F.concat(F.lower("n_name"), F.lit(".org")), F.lit("shared.example")).alias("official_domains"),
    )


@query(
    "organisation_lookup",
    "J13",
    "SELECT n_nationkey AS org_id, n_name AS display_name FROM nation WHERE n_name = 'NATION_7'",
)
def _(spark, sf):
    return Q.find_orgs(orgs(spark, sf), domain="nothing.example", name=" nation_7 LTD ").select("org_id", "display_name")


@query(
    "candidate_lookup",
    "J14",
    cte("candidates") + f", {NETWORKS} SELECT candidate_id FROM candidates WHERE CAST(candidate_id AS STRING) = '77' OR slug = '77' OR candidate_id IN (SELECT candidate_id FROM nets WHERE caip2 = '77' OR human_chain_id = '77')",
)
def _(spark, sf):
    return Q.find_candidates(role(spark, sf, "candidates"), networks(spark, sf), "77").select("candidate_id")


@query(
    "candidates_with_score",
    "J18",
    _ALL + "SELECT candidate_id, state, workflow_state, outreach_score FROM joined",
)
def _(spark, sf):
    return Q.with_current_score(role(spark, sf, "candidates"), role(spark, sf, "snapshots")).select("candidate_id", "state", "workflow_state", "outreach_score")


@query("unfunded_candidates", "J19", _ALL + "SELECT candidate_id FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM rounds)")
def _(spark, sf):
    return Q.filter_funding(role(spark, sf, "candidates"), role(spark, sf, "rounds"), has_funding=False).select("candidate_id")


@query(
    "pending_verification",
    "J20",
    cte("candidates") + f", {NETWORKS} SELECT candidate_id FROM candidates WHERE candidate_id IN (SELECT candidate_id FROM nets WHERE candidate_id % 3 <> 0) AND candidate_id NOT IN (SELECT user_id FROM events) ORDER BY first_seen_at DESC, candidate_id LIMIT 20",
)
def _(spark, sf):
    return Q.pending_verification(role(spark, sf, "candidates"), network_urls(spark, sf), role(spark, sf, "probes")).select("candidate_id")
