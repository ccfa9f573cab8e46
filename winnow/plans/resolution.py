"""Entity resolution queries (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.text import channel_hash
from winnow.operators import queues as Q
from winnow.operators import resolve as R
from winnow.plans.registry import query
from winnow.plans.roles import cte, role, sql_t, t, table


def _uuid(expr: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({expr}))"
    return (
        f"({h})[1:8] || '-' || ({h})[9:12] || '-5' || ({h})[14:16] || '-' || translate(({h})[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || ({h})[18:20] || '-' || ({h})[21:32]"
    )


def org_observations(spark, sf):
    """Orders as observations: a domain per customer, and GitHub organisations that chain
    neighbouring customers together over two different group sizes."""
    git = F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit("g"), F.floor(F.col("o_custkey") / 3).cast("string"))
    ).otherwise(F.concat(F.lit(" h"), F.floor(F.col("o_custkey") / 5).cast("string")))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("evidence_id"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.concat(F.lit("Chain "), F.col("o_custkey").cast("string")).alias("candidate_name"),
        F.lit(None).cast("string").alias("organization_name"),
        F.array(F.concat(F.lit("https://www.C"), F.col("o_custkey").cast("string"), F.lit(".example.com/x"))).alias("organization_domains"),
        F.array(git).alias("github_orgs"),
        F.array(F.concat(F.lit("Nation "), (F.col("o_custkey") % 25).cast("string"))).alias("claimed_locations"),
        F.create_map(F.lit("x"), F.concat(F.lit("@u"), (F.col("o_orderkey") % 7).cast("string"))).alias("social_handles"),
    )


_ORG_SQL = f"""WITH RECURSIVE obs AS (SELECT o_orderkey AS evidence_id, o_orderdate AS observed_at, o_custkey, 'c' || CAST(o_custkey AS STRING) || '.example.com' AS dom,
  CASE WHEN o_orderkey % 2 = 0 THEN 'g' || CAST(o_custkey // 3 AS STRING) ELSE 'h' || CAST(o_custkey // 5 AS STRING) END AS git FROM orders),
e AS (SELECT DISTINCT 'domain:' || dom AS a, 'github:' || git AS b FROM obs),
reach(a, b) AS (SELECT a, a FROM (SELECT a FROM e UNION SELECT b FROM e) UNION SELECT r.a, x.b FROM reach r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON r.b = x.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
oc AS (SELECT obs.*, component FROM obs JOIN comp ON comp.node = 'domain:' || dom),
heads AS (SELECT component, arg_min(dom, row(observed_at, evidence_id)) AS dom FROM oc GROUP BY 1),
ids AS (SELECT component, {_uuid("'org:domain:' || dom")} AS org_id FROM heads),
res AS (SELECT oc.*, org_id FROM oc JOIN ids USING (component))
"""


@query("organisation_resolution", "J1 N14 N17", _ORG_SQL + "SELECT evidence_id, org_id FROM res")
def _(spark, sf):
    return R.resolve_organizations(org_observations(spark, sf)).select("evidence_id", "org_id")


@query(
    "organisation_attributes",
    "J2",
    _ORG_SQL + """SELECT DISTINCT org_id, 'domain' AS kind, dom AS value FROM res UNION ALL SELECT DISTINCT org_id, 'github', git FROM res
UNION ALL SELECT DISTINCT org_id, 'location', 'Nation ' || CAST(o_custkey % 25 AS STRING) FROM res
UNION ALL SELECT org_id, 'social:x', arg_max('@u' || CAST(evidence_id % 7 AS STRING), row(observed_at, evidence_id)) FROM res GROUP BY 1""",
)
def _(spark, sf):
    return R.merge_org_attrs(R.resolve_organizations(org_observations(spark, sf)))


@query("organisation_bridges", "J1")
def _(spark, sf):
    return R.org_bridges(org_observations(spark, sf))


def candidate_observations(spark, sf):
    """Line items as observations of networks that suppliers publish."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("org_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("evidence_id"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.concat(F.lit("Net "), (F.col("l_partkey") % 20).cast("string")).alias("candidate_name"),
        F.lit("evm").alias("stack_family"),
        F.lit(None).cast("string").alias("protocol_namespace"),
        F.when(F.col("l_linenumber") > 2, (F.col("l_partkey") % 10).cast("string")).alias("human_chain_id"),
        F.when((F.col("l_linenumber") > 5) & (F.col("l_suppkey") % 10 == 0), F.lit("0xgenesis")).alias("genesis_fingerprint"),
        F.when(F.col("l_returnflag") == "R", "testnet").otherwise("mainnet").alias("environment"),
        F.lit(True).alias("is_public"),
        F.array(F.concat(F.lit("https://rpc"), (F.col("l_partkey") % 3).cast("string"), F.lit(".example.com"))).alias("rpc_urls"),
        F.array().cast("array<string>").alias("explorer_urls"),
        F.array().cast("array<string>").alias("faucet_urls"),
        F.create_map(F.concat(F.lit("k"), F.col("l_linenumber").cast("string")), F.col("l_returnflag")).alias("claims"),
        F.array(F.lower("l_returnflag")).alias("purpose_labels"),
    )


def _resolved(spark, sf):
    return R.resolve_candidates(R.with_network_identity(candidate_observations(spark, sf), unicode="native"))


_CAND_SQL = f"""WITH RECURSIVE obs AS (SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS evidence_id, l_shipdate AS observed_at, CAST(l_suppkey AS STRING) AS org, 'net-' || CAST(l_partkey % 20 AS STRING) AS slug,
 CASE WHEN l_linenumber > 2 THEN 'eip155:' || CAST(l_partkey % 10 AS STRING) END AS caip2, CASE WHEN l_linenumber > 5 AND l_suppkey % 10 = 0 THEN '0xgenesis' END AS gen FROM lineitem),
e AS (SELECT DISTINCT 's:' || org || ':' || slug AS a, 'n:' || org || ':' || caip2 AS b FROM obs WHERE caip2 IS NOT NULL UNION SELECT DISTINCT 's:' || org || ':' || slug, 'g:' || caip2 || ':' || gen FROM obs WHERE caip2 IS NOT NULL AND gen IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM (SELECT 's:' || org || ':' || slug AS a FROM obs UNION SELECT b FROM e) UNION SELECT r.a, x.b FROM reach r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON r.b = x.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
oc AS (SELECT obs.*, component FROM obs JOIN comp ON comp.node = 's:' || org || ':' || slug),
heads AS (SELECT component, arg_min(org || ':' || slug, row(observed_at, evidence_id)) AS k FROM oc GROUP BY 1),
ids AS (SELECT component, {_uuid("k")} AS candidate_id FROM heads)
"""


@query("candidate_resolution", "J3", _CAND_SQL + "SELECT evidence_id, candidate_id FROM oc JOIN ids USING (component)")
def _(spark, sf):
    return _resolved(spark, sf).select("evidence_id", "candidate_id")


@query(
    "candidate_aliases",
    "J7",
    _CAND_SQL + """, r AS (SELECT oc.*, candidate_id, 'Net ' || slug[5:] AS name, lower(l_returnflag) AS flag FROM oc JOIN ids USING (component) JOIN (SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS evidence_id, l_returnflag FROM lineitem) l USING (evidence_id))
SELECT DISTINCT candidate_id, 'alias' AS kind, name AS value FROM r UNION SELECT DISTINCT candidate_id, 'alias', lower(name) FROM r UNION SELECT DISTINCT candidate_id, 'purpose', flag FROM r""",
)
def _(spark, sf):
    return R.candidate_aliases(_resolved(spark, sf), unicode="native")


@query(
    "caip2_collisions",
    "J5",
    cte("claims_by_supplier") + f""", p AS (SELECT caip2, organization_id, min(row(observed_at, candidate_id)) AS c FROM claims_by_supplier GROUP BY 1, 2),
f AS (SELECT caip2, min(row(c[1], organization_id, c[2])) AS f, count(*) AS claimants FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT p.caip2, f.f[3] AS candidate_id, p.c[2] AS related_candidate_id, {sql_t('p.c[1]')} AS created_at, claimants FROM p JOIN f ON p.caip2 = f.caip2 WHERE p.organization_id <> f.f[2]""",
)
def _(spark, sf):
    df = R.caip2_collisions(role(spark, sf, "claims_by_supplier"))
    return df.select("caip2", "candidate_id", "related_candidate_id", t("created_at").alias("created_at"), "claimants")


def _named(spark, sf):
    """Parts as candidates: part names repeat across brands, which are the organisations."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("organization_id"), F.col("p_name").alias("canonical_name"),
        F.array("p_name").alias("aliases"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr("interval 1 minute") * ((F.col("p_partkey") * 7919) % 2000)).alias("first_seen_at"),
    )


@query(
    "weak_name_matches",
    "J6",
    """WITH c AS (SELECT p_partkey AS candidate_id, p_brand AS org, p_name AS name, (p_partkey * 7919) % 2000 AS at FROM part)
SELECT name AS alias, (SELECT arg_min(o.candidate_id, row(o.at, o.candidate_id)) FROM c o WHERE o.name = c.name AND o.org <> c.org AND row(o.at, o.candidate_id) < row(c.at, c.candidate_id)) AS candidate_id, c.candidate_id AS related_candidate_id
FROM c WHERE EXISTS (SELECT 1 FROM c o WHERE o.name = c.name AND o.org <> c.org AND row(o.at, o.candidate_id) < row(c.at, c.candidate_id))""",
)
def _(spark, sf):
    return R.weak_name_matches(_named(spark, sf)).select("alias", "candidate_id", "related_candidate_id")


_NET_SQL = """WITH obs AS (SELECT l_suppkey % 10 AS candidate_id, CAST(l_suppkey % 10 AS STRING) || '-' || l_returnflag AS network_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS evidence_id, l_shipdate AS observed_at,
 CASE WHEN l_linenumber > 2 THEN CAST(l_partkey % 10 AS STRING) END AS human_chain_id, CASE WHEN l_returnflag = 'R' THEN 'testnet' ELSE 'mainnet' END AS environment, l_partkey, l_linenumber, l_returnflag FROM lineitem)
"""


def _network_obs(spark, sf):
    o = candidate_observations(spark, sf).withColumn("candidate_id", F.col("org_id").cast("bigint") % 10)
    o = o.withColumn("protocol_namespace", F.lit("eip155")).withColumn("caip2", F.concat(F.lit("eip155:"), "human_chain_id"))
    flag = F.upper(F.col("purpose_labels")[0])
    return o.withColumn("network_id", F.concat(F.col("candidate_id").cast("string"), F.lit("-"), flag))


@query(
    "network_rollup",
    "J8",
    _NET_SQL + """SELECT network_id, arg_min(candidate_id, row(observed_at, evidence_id)) AS candidate_id, arg_min(environment, row(observed_at, evidence_id)) AS environment,
 arg_min(human_chain_id, row(observed_at, evidence_id)) FILTER (WHERE human_chain_id IS NOT NULL) AS human_chain_id, 'eip155:' || arg_min(human_chain_id, row(observed_at, evidence_id)) FILTER (WHERE human_chain_id IS NOT NULL) AS caip2 FROM obs GROUP BY 1""",
)
def _(spark, sf):
    return R.rollup_networks(_network_obs(spark, sf)).select("network_id", "candidate_id", "environment", "human_chain_id", "caip2")


@query("network_urls", "J8", _NET_SQL + "SELECT DISTINCT network_id, candidate_id, 'rpc' AS kind, 'https://rpc' || CAST(l_partkey % 3 AS STRING) || '.example.com' AS url FROM obs")
def _(spark, sf):
    return R.network_urls(_network_obs(spark, sf))


@query("network_claims", "J8", _NET_SQL + "SELECT network_id, 'k' || CAST(l_linenumber AS STRING) AS claim, arg_max(l_returnflag, row(observed_at, evidence_id)) AS value FROM obs GROUP BY 1, 2")
def _(spark, sf):
    return R.network_claims(_network_obs(spark, sf))


@query(
    "chain_id_changes",
    "J9",
    cte("claims_by_supplier") + f""", s AS (SELECT network_id, human_chain_id, min(row(observed_at, evidence_id)) AS fa, count(*) AS observations FROM claims_by_supplier WHERE human_chain_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, first_value(human_chain_id) OVER (PARTITION BY network_id ORDER BY fa) AS stored FROM s)
SELECT network_id, stored, human_chain_id AS observed, {sql_t('fa[1]')} AS created_at, observations FROM w WHERE human_chain_id <> stored""",
)
def _(spark, sf):
    return R.chain_id_changes(role(spark, sf, "claims_by_supplier")).select("network_id", "stored", "observed", t("created_at").alias("created_at"), "observations")


_INC = """, g AS (SELECT network_id, genesis_fingerprint, min(row(observed_at, evidence_id)) AS f FROM claims_by_supplier WHERE genesis_fingerprint <> '' GROUP BY 1, 2),
inc AS (SELECT network_id, genesis_fingerprint, f[1] AS first_seen_at, lead(genesis_fingerprint) OVER (PARTITION BY network_id ORDER BY f) AS next FROM g)
"""


@query(
    "incarnation_chains",
    "J10",
    cte("claims_by_supplier") + _INC + f"SELECT network_id, genesis_fingerprint, {sql_t('first_seen_at')} AS first_seen_at, CASE WHEN next IS NULL THEN 'active' ELSE 'superseded' END AS status, CASE WHEN next IS NOT NULL THEN {_uuid('network_id || chr(58) || next')} END AS superseded_by_id FROM inc",
)
def _(spark, sf):
    return R.incarnations(role(spark, sf, "claims_by_supplier")).select("network_id", "genesis_fingerprint", t("first_seen_at").alias("first_seen_at"), "status", "superseded_by_id")


@query("reset_tasks", "J10", cte("claims_by_supplier") + _INC + "SELECT network_id, count(*) AS resets FROM inc WHERE next IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return R.reset_tasks(R.incarnations(role(spark, sf, "claims_by_supplier"))).groupBy("network_id").agg(F.count("*").alias("resets"))


def _task_rows(spark, sf):
    c = role(spark, sf, "claims_by_supplier")
    return c.select(
        F.lit("chain_id_collision").alias("task_type"), F.col("caip2").alias("candidate_id"),
        F.when(F.col("organization_id") % 3 != 0, F.col("organization_id").cast("string")).alias("related_candidate_id"),
        F.regexp_extract("evidence_id", "^[0-9]+", 0).alias("evidence_id"), F.col("observed_at").alias("at"),
    )


@query(
    "review_task_upsert",
    "J11",
    cte("claims_by_supplier") + f"""SELECT caip2 AS candidate_id, CASE WHEN organization_id % 3 <> 0 THEN CAST(organization_id AS STRING) ELSE '' END AS related_candidate_id, {sql_t('min(observed_at)')} AS created_at,
 count(DISTINCT split_part(evidence_id, '-', 1)) AS n_evidence FROM claims_by_supplier GROUP BY 1, 2""",
)
def _(spark, sf):
    return R.upsert_review_tasks(_task_rows(spark, sf)).select("candidate_id", "related_candidate_id", t("created_at").alias("created_at"), "n_evidence")


@query(
    "risk_signal_upsert",
    "J12",
    cte("probes") + f"SELECT candidate_id, failure_class AS signal_type, {sql_t('min(observed_at)')} AS first_at, count(DISTINCT probe_id) AS n_evidence FROM probes WHERE NOT success GROUP BY 1, 2",
)
def _(spark, sf):
    p = role(spark, sf, "probes").filter("NOT success").select("candidate_id", F.col("failure_class").alias("signal_type"), F.col("probe_id").alias("evidence_id"), F.col("observed_at").alias("at"))
    return R.upsert_signals(p).select("candidate_id", "signal_type", t("first_at").alias("first_at"), "n_evidence")


@query(
    "unsuppressed_contacts",
    "J16",
    cte("contacts") + "SELECT contact_id FROM contacts WHERE lower(trim(channel_value)) NOT IN (SELECT lower(trim(channel_value)) FROM contacts WHERE suppressed)",
)
def _(spark, sf):
    c = role(spark, sf, "contacts")
    return R.drop_suppressed(c, c.filter("suppressed").select(channel_hash(F.col("channel_value")).alias("channel_hash"))).select("contact_id")


@query(
    "contact_upsert",
    "J17",
    cte("contacts") + """, n AS (SELECT lower(trim(channel_value)) AS h, org_id, min(contact_id) AS contact_id FROM contacts WHERE NOT suppressed GROUP BY 1, 2)
SELECT contact_id FROM n WHERE NOT EXISTS (SELECT 1 FROM contacts e WHERE suppressed AND lower(trim(e.channel_value)) = n.h AND e.org_id = n.org_id)""",
)
def _(spark, sf):
    c = role(spark, sf, "contacts")
    old = c.filter("suppressed").withColumn("channel_hash", channel_hash(F.col("channel_value")))
    return R.upsert_contacts(c.filter("NOT suppressed"), old).select("contact_id")


@query(
    "visible_events",
    "J21",
    cte("evidence") + """, cuts AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 5 DAY)) AS TIMESTAMP) AS cutoff), ab(ablation) AS (VALUES (''), ('social'), ('registry'))
SELECT strftime(cutoff, '%Y-%m-%d') AS cutoff, ablation, count(*) AS n, count(DISTINCT candidate_id) AS candidates FROM evidence, cuts, ab WHERE observed_at <= cutoff AND (ablation = '' OR source_family <> ablation) GROUP BY 1, 2""",
)
def _(spark, sf):
    cuts = spark.sql("SELECT explode(sequence(timestamp'2024-01-05 00:00:00', timestamp'2024-01-31 00:00:00', interval 5 days)) AS cutoff")
    ab = spark.createDataFrame([("",), ("social",), ("registry",)], "ablation string")
    v = R.visible_events(role(spark, sf, "evidence"), cuts, ab)
    return v.groupBy(F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "ablation").agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("candidates"))


@query(
    "candidate_documents",
    "J22",
    cte("candidates", "rounds", "snapshots") + """SELECT candidate_id, 'candidate' AS section, '' AS key FROM candidates UNION ALL SELECT candidate_id, 'funding', CAST(round_id AS STRING) FROM rounds
UNION ALL SELECT candidate_id, 'score', CAST(snapshot_id AS STRING) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY calculated_at DESC, snapshot_id DESC) rn FROM snapshots) WHERE rn = 1""",
)
def _(spark, sf):
    kids = {"funding": (role(spark, sf, "rounds"), "round_id"), "score": (Q.current_scores(role(spark, sf, "snapshots")), "snapshot_id")}
    return R.candidate_documents(role(spark, sf, "candidates"), kids).select("candidate_id", "section", "key")
