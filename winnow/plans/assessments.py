"""Assessment, vitality, fit, privacy, alert and card queries (C9–C10, C22–C28, P, SO3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.ordered import top_n
from winnow.functions.text import channel_hash
from winnow.operators import assess as A
from winnow.operators import cards as K
from winnow.operators import privacy as P
from winnow.operators import queues as Q
from winnow.operators import verify as V
from winnow.plans.queues import _ALL, _ORDER, NETWORKS, networks
from winnow.plans.registry import query
from winnow.plans.roles import AS_OF, LATER, cte, r, register, role, sql_t, t, table
from winnow.plans.texts import FEATURES_SQL, docs
from winnow.settings import DEFAULT

_CONF = "CASE WHEN label = 'A4_no_evidence' THEN 0 ELSE round((0.45 + CASE WHEN near THEN 0.25 WHEN wide THEN 0.15 ELSE 0 END + CASE WHEN is_official_source THEN 0.20 ELSE 0 END - CASE WHEN len(rejected) > 0 THEN 0.10 ELSE 0 END)::DOUBLE, 2) END"
_RANK = "CASE label WHEN 'A4_no_evidence' THEN 0 WHEN 'A3_africa_compatible' THEN 1 WHEN 'A2_active_regional_motion' THEN 2 WHEN 'A1_explicit_intent' THEN 3 ELSE 4 END"


def _features(spark, sf):
    from winnow.operators.geography import africa_features
    from winnow.sources.lexicon import default_lexicon

    df = africa_features(docs(spark, sf, flags=True), default_lexicon(spark))
    return (
        df.withColumn("candidate_id", F.col("doc_id") % 60).withColumn("evidence_id", F.col("doc_id"))
        .withColumn("observed_at", F.timestamp_seconds(F.col("doc_id")))
    )


def _overrides(spark, sf):
    e = table(spark, sf, "events").filter("user_id % 10 = 0 AND user_id < 60")
    return e.select(
        F.col("user_id").alias("candidate_id"), F.col("event_id"), F.col("ts").cast("timestamp").alias("at"),
        F.lit("A2_active_regional_motion").alias("intent_label"), F.when(F.col("user_id") % 20 == 0, F.floor("value").cast("double")).alias("manual_score"),
    )


@query(
    "assessment_rollup",
    "C9 P9",
    FEATURES_SQL + f""", x AS (SELECT *, doc_id % 60 AS candidate_id, {_RANK} AS rk, {_CONF} AS conf FROM feat),
g AS (SELECT candidate_id, max(eg) + max(ra) + max(uc) + max(ws) + max(ct) + max(oc) AS tot, arg_max(label, row(rk, doc_id)) AS label, arg_max(conf, row(rk, doc_id)) AS conf, count(*) AS n_evidence FROM x GROUP BY 1),
o AS (SELECT user_id AS candidate_id, arg_max(CASE WHEN user_id % 20 = 0 THEN floor(value) ELSE -1 END, row(ts, event_id)) AS ms FROM events WHERE user_id % 10 = 0 AND user_id < 60 GROUP BY 1)
SELECT g.candidate_id, CASE WHEN o.candidate_id IS NOT NULL THEN 'A2_active_regional_motion' ELSE label END AS intent_label, conf AS confidence, coalesce(CASE WHEN ms >= 0 THEN ms END, least(100, tot))::DOUBLE AS total_score, n_evidence, o.candidate_id IS NOT NULL AS overridden FROM g LEFT JOIN o USING (candidate_id)""",
)
def _(spark, sf):
    out = A.rollup_assessments(_features(spark, sf), _overrides(spark, sf))
    return out.select("candidate_id", "intent_label", "confidence", "total_score", "n_evidence", "overridden")


@query(
    "assessment_places",
    "C9",
    FEATURES_SQL + """SELECT DISTINCT doc_id % 60 AS candidate_id, 'country' AS kind, unnest(countries) AS name FROM feat UNION SELECT DISTINCT doc_id % 60, 'region', unnest(regions || blocs) FROM feat
UNION SELECT DISTINCT doc_id % 60, 'language', unnest(langs) FROM feat UNION SELECT DISTINCT doc_id % 60, 'rail', unnest(rails || curs) FROM feat""",
)
def _(spark, sf):
    return A.assessment_places(_features(spark, sf))


@query(
    "source_flags",
    "C10",
    cte("evidence", "register") + """SELECT evidence_id, source_family IN ('registry', 'official_web') OR coalesce(tier = 'A', FALSE) AS is_official_source,
 source_family IN ('code_search', 'careers', 'official_web', 'registry', 'infrastructure') AS is_activity FROM evidence e LEFT JOIN register r ON e.source_id = r.source_id""",
)
def _(spark, sf):
    return A.source_flags(role(spark, sf, "evidence"), register(spark)).select("evidence_id", "is_official_source", "is_activity")


def _labels(spark, sf):
    return role(spark, sf, "candidates").select("candidate_id", F.when(F.col("candidate_id") % 3 == 0, "Token").otherwise("defi").alias("label"))


@query("token_only_candidates", "C23", cte("candidates") + f", {NETWORKS} SELECT candidate_id FROM candidates WHERE candidate_id % 3 = 0 AND candidate_id NOT IN (SELECT candidate_id FROM nets WHERE caip2 IS NOT NULL) AND NOT (candidate_id % 2 = 0 AND candidate_id % 3 <> 0)")
def _(spark, sf):
    from winnow.plans.queues import network_urls

    return A.token_only(role(spark, sf, "candidates"), networks(spark, sf), network_urls(spark, sf), _labels(spark, sf))


@query(
    "risk_scores",
    "C22",
    cte("users", "probes") + """, v AS (SELECT candidate_id, bool_or(failure_class = 'identity_mismatch') AS im, count(*) FILTER (WHERE NOT success AND failure_class <> 'identity_mismatch') >= 2 AS et FROM probes GROUP BY 1),
x AS (SELECT u.candidate_id, coalesce(im, FALSE) OR u.candidate_id % 11 = 0 AS a, NOT (has_domain OR has_repo) AS b, u.candidate_id % 29 = 0 AS c, coalesce(et, FALSE) AS d FROM users u LEFT JOIN v ON u.candidate_id = v.candidate_id)
SELECT candidate_id, (CASE WHEN a THEN 30 ELSE 0 END + CASE WHEN b THEN 25 ELSE 0 END + CASE WHEN c THEN 25 ELSE 0 END + CASE WHEN d THEN 10 ELSE 0 END)::DOUBLE AS risk,
 CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) + CAST(d AS BIGINT) AS n_flags FROM x""",
)
def _(spark, sf):
    u = role(spark, sf, "users").select("candidate_id", "has_domain", "has_repo")
    signals = u.filter("candidate_id % 11 = 0").select("candidate_id", F.lit("genesis_changed").alias("signal_type"))
    facts = A.risk_facts(u, signals, V.verification_summary(role(spark, sf, "probes")), u.filter("candidate_id % 29 = 0"))
    return A.risk_scores(facts).select("candidate_id", "risk", F.size("risk_flags").cast("bigint").alias("n_flags"))


_W = "CASE channel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEFAULT.channel_weights.items()) + " ELSE 0.01 END"
_VIT = f""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, channel ORDER BY observed_at DESC, snapshot_id DESC) rn FROM activity) WHERE rn = 1),
a AS (SELECT *, (epoch(TIMESTAMP '{LATER}') - epoch(last_activity_at)) / 86400 AS age, ({_W})::DOUBLE AS w FROM l),
v0 AS (SELECT candidate_id, sum(w) FILTER (WHERE age IS NOT NULL) AS sw, sum(w * CASE WHEN age <= 0 THEN 1 ELSE pow(0.5::DOUBLE, (age / 45)::DOUBLE) END) FILTER (WHERE age IS NOT NULL) AS swd, min(age) AS newest, count(*) AS n,
  coalesce(bool_or(channel IN ('rpc', 'explorer') AND age <= 30), FALSE) AS tech, candidate_id % 4 = 0 AS adv FROM a GROUP BY 1),
vit AS (SELECT *, CASE WHEN newest IS NULL THEN 'unknown' WHEN newest <= 30 THEN 'active' WHEN newest <= 90 THEN 'slowing' WHEN newest <= 180 THEN CASE WHEN adv THEN 'slowing' ELSE 'dormant' END ELSE CASE WHEN adv THEN 'slowing' ELSE 'dead' END END AS vitality,
  CASE WHEN newest IS NULL THEN 0 ELSE greatest(100.0::DOUBLE * swd / sw, CASE WHEN adv THEN 60 ELSE 0 END) END AS vscore FROM v0)
"""


def _live(spark, sf):
    return role(spark, sf, "activity").select("candidate_id", (F.col("candidate_id") % 4 == 0).alias("live")).distinct()


def _daily(spark, sf):
    """Activity by user and day, so that every status occurs."""
    return role(spark, sf, "activity").withColumn("candidate_id", F.col("candidate_id") * 100 + F.dayofmonth("observed_at"))


_DAILY = cte("activity").replace("user_id AS candidate_id", "user_id * 100 + day(ts) AS candidate_id")


@query("vitality", "C24 W1", _DAILY + _VIT + "SELECT candidate_id, vitality, round(vscore, 6) AS vitality_score, n AS observed_channels, newest IS NOT NULL AND (adv OR tech) AS technical_liveness FROM vit")
def _(spark, sf):
    act = _daily(spark, sf)
    live = act.select("candidate_id", (F.col("candidate_id") % 4 == 0).alias("live"))
    v = A.assess_vitality(act, LATER, live)
    return v.select("candidate_id", "vitality", r("vitality_score").alias("vitality_score"), "observed_channels", "technical_liveness")


@query("unobserved_channels", "SO3 C25", cte("activity") + ", ch(channel) AS (VALUES " + ", ".join(f"('{k}')" for k in DEFAULT.channel_weights) + ") SELECT DISTINCT a.candidate_id, ch.channel FROM activity a, ch WHERE NOT EXISTS (SELECT 1 FROM activity b WHERE b.candidate_id = a.candidate_id AND b.channel = ch.channel)")
def _(spark, sf):
    return A.unobserved_channels(role(spark, sf, "activity"))


_AUD = "aud AS (SELECT candidate_id, sum(followers)::DOUBLE AS f, sum(stars)::DOUBLE AS s, sum(contributors)::DOUBLE AS c FROM activity GROUP BY 1)"
_REACH = "least(1, 0.5::DOUBLE * (log10(f + 1) / 6.0::DOUBLE) + 0.35::DOUBLE * (log10(s + 1) / 4.5::DOUBLE) + 0.15::DOUBLE * (log10(c + 1) / 2.5::DOUBLE))"


@query("audience_reach", "C26", cte("activity") + f", {_AUD} SELECT candidate_id, round({_REACH}, 6) AS reach FROM aud")
def _(spark, sf):
    return A.audience_score(role(spark, sf, "activity")).select("candidate_id", r("reach").alias("reach"))


_BANDS = "CASE candidate_id % 5 WHEN 0 THEN 'well_funded' WHEN 1 THEN 'materially_funded' WHEN 2 THEN 'lightly_funded' WHEN 3 THEN 'raised_amount_undisclosed' ELSE 'no_public_funding_evidence' END"


@query(
    "outreach_fit",
    "C27 C24 C26",
    cte("activity", "users") + _VIT + f""", {_AUD}, gh AS (SELECT candidate_id, commits_last_30d AS cm, releases_last_90d AS rl FROM l WHERE channel = 'github'),
x AS (SELECT u.*, vitality, vscore, {_REACH} AS reach, cm, rl, {_BANDS.replace('candidate_id', 'u.candidate_id')} AS band FROM users u JOIN vit USING (candidate_id) JOIN aud USING (candidate_id) LEFT JOIN gh USING (candidate_id)),
y AS (SELECT *, 100 * (0.22::DOUBLE * CASE band WHEN 'well_funded' THEN 1 WHEN 'materially_funded' THEN 0.8 WHEN 'lightly_funded' THEN 0.5 WHEN 'raised_amount_undisclosed' THEN 0.45 ELSE 0.2 END::DOUBLE
 + 0.20::DOUBLE * CASE stage WHEN 'S2_public_testnet' THEN 1 WHEN 'S3_incentivized_testnet' THEN 1 WHEN 'S4_mainnet_announced' THEN 0.95 WHEN 'S5_early_mainnet' THEN 0.85 WHEN 'S1_devnet_prototype' THEN 0.5 WHEN 'S0_research_hint' THEN 0.15 ELSE 0.25 END::DOUBLE
 + 0.25::DOUBLE * least(1, fit / 100 + CASE label WHEN 'A1_explicit_intent' THEN 0.15 WHEN 'A2_active_regional_motion' THEN 0.10 ELSE 0 END::DOUBLE) + 0.13::DOUBLE * reach
 + 0.12::DOUBLE * CASE WHEN has_social THEN 1 ELSE 0 END + 0.08::DOUBLE * least(1, coalesce(cm, 0) / 40.0::DOUBLE * 0.7::DOUBLE + least(coalesce(rl, 0), 5) / 5.0::DOUBLE * 0.3::DOUBLE)) * (vscore / 100) AS s,
 (NOT has_social)::INT + (vitality IN ('dead', 'dormant', 'unknown'))::INT + (NOT has_repo)::INT + (risk >= 34)::INT AS nb FROM x)
SELECT candidate_id, round(s, 6) AS fit_score, CAST(nb AS BIGINT) AS n_blockers, CASE WHEN vitality = 'dead' THEN 'do_not_contact' WHEN nb > 0 THEN 'not_ready' WHEN s >= 65 THEN 'prime' WHEN s >= 45 THEN 'strong' WHEN s >= 25 THEN 'watch' ELSE 'not_ready' END AS tier FROM y""",
)
def _(spark, sf):
    act = role(spark, sf, "activity")
    gh = Q.latest_per_channel(act.filter("channel = 'github'")).select("candidate_id", F.col("commits_last_30d").alias("commits"), F.col("releases_last_90d").alias("releases"))
    df = (
        role(spark, sf, "users").join(A.assess_vitality(act, LATER, _live(spark, sf)), "candidate_id")
        .join(A.audience_score(act).select("candidate_id", "reach"), "candidate_id").join(gh, "candidate_id", "left")
    )
    df = (
        df.withColumn("band", F.expr(_BANDS)).withColumn("total_disclosed_usd", F.lit(None).cast("double")).withColumn("archived", F.lit(False))
        .withColumn("has_public_contact", F.col("has_social")).withColumn("gate_passed", F.col("has_repo")).withColumn("opportunity_type", F.lit("developer_relations"))
    )
    return A.outreach_fit(df).select("candidate_id", r("fit_score").alias("fit_score"), F.size("blockers").cast("bigint").alias("n_blockers"), "tier")


@query(
    "activity_build",
    "C28",
    cte("evidence", "probes") + f""", x AS (SELECT candidate_id, source_id, observed_at, (epoch(TIMESTAMP '{LATER}') - epoch(observed_at)) / 86400 AS age FROM evidence)
SELECT candidate_id, 'github' AS channel, {sql_t('max(observed_at)')} AS last_activity_at, count(*) FILTER (WHERE source_id = 'click' AND age <= 30) AS commits_last_30d, count(*) FILTER (WHERE source_id = 'view' AND age <= 90) AS releases_last_90d, CAST(NULL AS BIGINT) AS posts_last_30d, CAST(NULL AS BIGINT) AS block_height FROM x WHERE source_id IN ('click', 'view') GROUP BY 1
UNION ALL SELECT candidate_id, 'website', {sql_t('max(observed_at)')}, NULL, NULL, count(*) FILTER (WHERE age <= 30), NULL FROM x WHERE source_id = 'signup' GROUP BY 1
UNION ALL SELECT candidate_id, 'rpc', {sql_t('observed_at')}, NULL, NULL, NULL, block_height FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY observed_at DESC, probe_id DESC) rn FROM probes WHERE success) WHERE rn = 1""",
)
def _(spark, sf):
    ev = role(spark, sf, "evidence")
    part = lambda s: ev.filter(F.col("source_id") == s).select("candidate_id", F.col("observed_at").alias("at"))
    out = A.activity_snapshots(part("click"), part("view"), part("signup"), role(spark, sf, "probes"), LATER)
    return out.select("candidate_id", "channel", t("last_activity_at").alias("last_activity_at"), "commits_last_30d", "releases_last_90d", "posts_last_30d", "block_height")


# -- privacy, alerts, analyst decisions ------------------------------------------------------------


@query(
    "suppressions_applied",
    "P1",
    cte("contacts") + """, rq AS (SELECT DISTINCT lower(trim(channel_value)) AS v FROM (SELECT 'team-' || CAST(s_suppkey % 60 AS STRING) || '@example.com' AS channel_value FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'gone-' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 9 = 0))
SELECT coalesce(sha256(lower(trim(c.channel_value))), sha256(rq.v)) AS channel_hash, c.contact_id, coalesce(c.channel_value, '[REDACTED-HASH-ONLY]') AS channel_value, coalesce(c.suppressed, FALSE) OR rq.v IS NOT NULL AS suppressed FROM contacts c FULL JOIN rq ON lower(trim(c.channel_value)) = rq.v""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    a = s.filter("s_suppkey % 7 = 0").select(F.concat(F.lit("TEAM-"), (F.col("s_suppkey") % 60).cast("string"), F.lit("@example.com")).alias("channel_value"))
    b = s.filter("s_suppkey % 9 = 0").select(F.concat(F.lit("gone-"), F.col("s_suppkey").cast("string")).alias("channel_value"))
    return P.apply_suppressions(role(spark, sf, "contacts"), a.unionByName(b)).select("channel_hash", "contact_id", "channel_value", "suppressed")


@query(
    "contact_retention",
    "P2",
    cte("contacts") + f"SELECT contact_id FROM contacts WHERE suppressed OR (epoch(TIMESTAMP '{AS_OF}') - epoch(last_verified_at)) / 86400 <= 90",
)
def _(spark, sf):
    return P.expire_contacts(role(spark, sf, "contacts"), AS_OF).select("contact_id")


def hot_events(spark, sf):
    """Error events as HOT transitions of their user with a coarse evidence count."""
    return role(spark, sf, "evidence").filter("source_id = 'error'").select(
        "candidate_id", F.lit("HOT").alias("state"), F.lit("S2_public_testnet").alias("stage"), F.lit("A1_explicit_intent").alias("label"),
        F.lit(1).alias("evidence_count"), F.col("observed_at").alias("calculated_at"), F.col("external_id").alias("snapshot_id"),
    )


@query(
    "alert_log",
    "P3 T5",
    """WITH RECURSIVE ev AS (SELECT DISTINCT user_id AS k, ts FROM events WHERE event_type = 'error'),
sent(k, ts) AS (SELECT k, min(ts) FROM ev GROUP BY 1 UNION ALL SELECT s.k, (SELECT min(e.ts) FROM ev e WHERE e.k = s.k AND e.ts > s.ts + INTERVAL 24 HOUR) FROM sent s WHERE s.ts IS NOT NULL)
SELECT k AS candidate_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sent_at FROM sent WHERE ts IS NOT NULL""",
)
def _(spark, sf):
    log = P.alert_log(P.alert_dedup_key(hot_events(spark, sf)))
    return log.select("candidate_id", t("calculated_at").alias("sent_at"))


@query(
    "workflow_transitions",
    "P8",
    cte("candidates", "snapshots") + """, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY calculated_at DESC, snapshot_id DESC) rn FROM snapshots) WHERE rn = 1),
ev AS (SELECT user_id AS candidate_id, arg_max(event_type, row(ts, event_id)) AS wf FROM events GROUP BY 1)
SELECT c.candidate_id, coalesce(wf, workflow_state) AS workflow_state FROM cur c LEFT JOIN ev USING (candidate_id)""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("workflow_state"))
    return P.apply_transitions(Q.current_scores(role(spark, sf, "snapshots")), ev).select("candidate_id", "workflow_state")


@query(
    "analyst_overrides",
    "P9",
    cte("assessments") + """, o AS (SELECT user_id AS candidate_id, arg_max(CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE -1 END, row(ts, event_id)) AS ms FROM events WHERE user_id % 3 = 0 GROUP BY 1)
SELECT a.candidate_id, CASE WHEN o.candidate_id IS NULL THEN intent_label ELSE 'A1_explicit_intent' END AS intent_label, coalesce(CASE WHEN ms >= 0 THEN ms END, total_score) AS total_score, o.candidate_id IS NOT NULL AS overridden FROM assessments a LEFT JOIN o USING (candidate_id)""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").filter("user_id % 3 = 0").select(
        F.col("user_id").alias("candidate_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.lit("A1_explicit_intent").alias("intent_label"),
        F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("double")).alias("manual_score"),
    )
    return P.apply_overrides(role(spark, sf, "assessments"), ev).select("candidate_id", "intent_label", "total_score", "overridden")


def _task_events(spark, sf):
    tasks = role(spark, sf, "snapshots").select(F.col("snapshot_id").alias("task_id"), F.when(F.col("workflow_state") == "NEW", "open").otherwise("resolved").alias("status"))
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") * 20).alias("task_id"), F.lit("approve").alias("resolution"), F.lit("analyst").alias("actor"), F.col("ts").cast("timestamp").alias("at"))
    return P.resolve_tasks(tasks, ev)


@query(
    "task_resolution",
    "P10",
    cte("snapshots") + """, f AS (SELECT user_id * 20 AS task_id, arg_min(event_id, row(ts, event_id)) AS e FROM events GROUP BY 1)
SELECT snapshot_id AS task_id, CASE WHEN workflow_state <> 'NEW' OR e IS NOT NULL THEN 'resolved' ELSE 'open' END AS status, CASE WHEN workflow_state = 'NEW' THEN e END AS resolved_by_event FROM snapshots LEFT JOIN f ON snapshot_id = task_id""",
)
def _(spark, sf):
    return _task_events(spark, sf)[0].select("task_id", "status", "resolved_by_event")


@query(
    "rejected_resolutions",
    "P10",
    cte("snapshots") + """, f AS (SELECT user_id * 20 AS task_id, arg_min(event_id, row(ts, event_id)) AS e FROM events GROUP BY 1)
SELECT event_id FROM events WHERE event_id NOT IN (SELECT e FROM f JOIN snapshots ON snapshot_id = task_id WHERE workflow_state = 'NEW')""",
)
def _(spark, sf):
    return _task_events(spark, sf)[1].select("event_id")


# -- cards and digests -------------------------------------------------------------------------------


def _card_base(spark, sf):
    c, s, a, rd = (role(spark, sf, n) for n in ("candidates", "snapshots", "assessments", "rounds"))
    df = Q.with_current_score(c, s).join(a.select("candidate_id", "intent_label", F.col("total_score").alias("fit")), "candidate_id", "left")
    n = networks(spark, sf).select("candidate_id", "caip2", "human_chain_id")
    df = df.join(n, "candidate_id", "left").withColumn("countries", F.when(F.col("candidate_id") % 2 == 0, F.array(F.lit("Kenya"), F.lit("Nigeria"))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("organization", F.concat(F.lit("Org "), F.col("organization_id").cast("string"))).withColumn("genesis_fingerprint", F.lit(None).cast("string"))
    return K.evidence_cards(df.withColumn("momentum", F.lit(0.0)), role(spark, sf, "evidence"), rd)


@query(
    "evidence_cards",
    "P5 W5",
    _ALL.replace("WITH ", "WITH ev AS (SELECT user_id AS candidate_id, count(*) AS n FROM events GROUP BY 1),\n", 1) + """SELECT candidate_id, coalesce(n, 0) AS evidence_count, CASE WHEN state = 'HOT' AND (intent_label LIKE 'A1%' OR intent_label LIKE 'A2%') THEN 'Write a launch brief covering ' || CASE WHEN candidate_id % 2 = 0 THEN 'Kenya, Nigeria' ELSE 'regional expansion' END
 WHEN state = 'HOT' THEN 'Have a person check readiness and possible entry points' WHEN state = 'QUALIFIED' THEN 'Discuss in the daily digest' ELSE 'Keep watching' END AS recommendation FROM joined LEFT JOIN ev USING (candidate_id)""",
)
def _(spark, sf):
    return _card_base(spark, sf).select("candidate_id", "evidence_count", "recommendation")


@query("alert_payloads", "P4")
def _(spark, sf):
    return K.alert_payload(_card_base(spark, sf).filter("state = 'HOT'"))


@query("card_markdown", "P6")
def _(spark, sf):
    return K.render_markdown(_card_base(spark, sf))


def _digest(spark, sf):
    return K.digest(Q.joined_candidates(*(role(spark, sf, n) for n in ("candidates", "snapshots", "assessments", "rounds"))))


@query(
    "digest",
    "P7 O1",
    _ALL + f""", d AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY {_ORDER}) AS p FROM joined)
SELECT state, candidate_id, CAST(p AS INT) AS position FROM d WHERE (state = 'HOT' AND p <= 20) OR (state = 'QUALIFIED' AND p <= 30) OR (state = 'RADAR' AND p <= 20)""",
)
def _(spark, sf):
    return _digest(spark, sf).select("state", "candidate_id", "position")


@query("digest_markdown", "P6 P7")
def _(spark, sf):
    return K.digest_markdown(_digest(spark, sf), "Early network digest")
