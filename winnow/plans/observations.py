"""Normalisation, export, backtest and streaming queries (N1–N10, SO1, S8, S9, B, T)."""

from __future__ import annotations


from pyspark.sql import functions as F

from winnow.operators import backtest as B
from winnow.operators import normalize as N
from winnow.operators import queues as Q
from winnow.plans.queues import _ALL, _ORDER
from winnow.plans.registry import query
from winnow.plans.roles import cte, r, role, sql_t, t, table
from winnow.plans.scores import scored_sql
from winnow.plans.texts import FEATURES_SQL
from winnow.sources import tables as TB
from winnow.sources.lexicon import countries_dim, default_lexicon

_K, _C = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"
_PR_SOURCE = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{rule[0]}'" for i, rule in enumerate(N.PR_RULES)) + " END"
_PR_TITLE = f"CASE WHEN o_orderkey % 41 = 0 THEN 'Add' ELSE 'Add Net' || {_C} || CASE o_orderkey % 3 WHEN 0 THEN ' mainnet chain' WHEN 1 THEN ' testnet' ELSE '' END || ' (chainId: ' || {_K} || ')' END"
_PR_BODY = f"'RPC https://a.rpc' || {_C} || '.example.com/x, https://a.rpc' || {_C} || '.example.com/x or https://b.explorer.example.com/' || {_K} || CASE o_orderkey % 5 WHEN 0 THEN ' cosmos chain_id = net-' || {_C} WHEN 1 THEN ' chain_id: ' || {_K} WHEN 2 THEN ' on Solana' ELSE '' END"


def _raw(df, source, **payload):
    """Raw items whose payload is the JSON of the given columns."""
    return df.select(
        source.alias("source_id"), F.col("external_id").cast("string"), F.col("observed_at"),
        F.to_json(F.struct(*[c.alias(k) for k, c in payload.items()])).alias("payload"),
    )


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("external_id", F.col("o_orderkey")).withColumn("observed_at", F.col("o_orderdate").cast("timestamp"))


def _pr_raw(spark, sf):
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _raw(
        _orders(spark, sf), F.expr(_PR_SOURCE), pr_number=F.col("o_orderkey"), title=F.expr(_PR_TITLE), body=F.expr(_PR_BODY),
        created_at=at, merged_at=F.when(F.col("o_orderkey") % 2 == 0, at), user=F.concat(F.lit("u"), F.col("o_custkey").cast("string")),
    )


def _rule_case(i: int) -> str:
    """One attribute of the rule table as CASE over the source."""
    def lit(v):
        return "NULL" if v is None else ("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v))

    return "CASE source_id " + " ".join(f"WHEN '{rule[0]}' THEN {lit(rule[i])}" for rule in N.PR_RULES) + " END"


@query(
    "registry_pull_requests",
    "N1",
    f"""WITH p AS (SELECT o_orderkey, {_PR_SOURCE} AS source_id, {_PR_TITLE} AS title, {_PR_TITLE} || chr(10) || {_PR_BODY} AS txt FROM orders),
q AS (SELECT *, lower(txt) AS low, trim(split_part(regexp_replace(title, {_rule_case(1)}, '', 'g'), '(', 1)) AS nm, {_rule_case(6)} AS fam, {_rule_case(2)} AS prefix, {_rule_case(5)} AS base, source_id = 'caip_namespaces' AS caip,
  CASE WHEN source_id IN ('superchain_registry') THEN regexp_extract(txt, '(?i)chain_id[:\\s=]+(\\d+)', 1) WHEN source_id = 'cosmos_chain_registry' THEN regexp_extract(txt, '(?i)chain_id[:\\s=]+([\\w-]+)', 1)
       WHEN source_id = 'caip_namespaces' THEN '' ELSE regexp_extract(txt, '(?i)chainId[:\\s=]+(\\d+)', 1) END AS cid FROM p),
s AS (SELECT *, CASE WHEN source_id = 'hyperlane_registry' AND (low LIKE '%sealevel%' OR low LIKE '%solana%') THEN 'svm' WHEN source_id IN ('hyperlane_registry', 'axelar_configs') AND low LIKE '%cosmos%' THEN 'cosmos' ELSE fam END AS stack FROM q)
SELECT CAST(o_orderkey AS STRING) AS evidence_id, CASE WHEN len(nm) >= 2 THEN nm ELSE prefix || CAST(o_orderkey AS STRING) END AS candidate_name, stack AS stack_family,
 CASE WHEN caip THEN 'devnet' WHEN low LIKE '%mainnet%' THEN 'mainnet' ELSE 'testnet' END AS environment,
 CASE WHEN caip THEN 'S0_research_hint' WHEN low LIKE '%mainnet%' THEN 'S4_mainnet_announced' WHEN source_id = 'ethereum_lists' AND low LIKE '%testnet%' THEN 'S2_public_testnet' ELSE base END AS stage,
 nullif(cid, '') AS human_chain_id, CASE WHEN stack = 'evm' OR fam = 'cosmos' THEN CASE WHEN stack = 'evm' THEN 'eip155' ELSE 'cosmos' END || ':' || nullif(cid, '') END AS caip2,
 CASE WHEN caip THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '(?i)https?://[^\\s<>"'']+(?:rpc|node)[^\\s<>"'']*'))), ' ') END AS rpc_urls FROM s""",
)
def _(spark, sf):
    o = N.normalize_registry_prs(_pr_raw(spark, sf))
    return o.select("evidence_id", "candidate_name", "stack_family", "environment", "stage", "human_chain_id", "caip2", F.array_join("rpc_urls", " ").alias("rpc_urls"))


def _cust(spark, sf):
    return table(spark, sf, "customer").withColumn("external_id", F.col("c_custkey")).withColumn("observed_at", F.timestamp_seconds("c_custkey"))


@query(
    "evm_chain_definitions",
    "N2",
    """SELECT CAST(c_custkey AS STRING) AS evidence_id, 'eip155:' || CAST(c_custkey AS STRING) AS caip2, CASE WHEN c_custkey % 3 = 0 THEN 'mainnet' ELSE 'testnet' END AS environment,
 CASE WHEN c_custkey % 3 = 0 THEN 'S4_mainnet_announced' WHEN c_custkey % 3 = 1 THEN 'S2_public_testnet' ELSE 'S1_devnet_prototype' END AS stage, CASE WHEN c_custkey % 2 = 0 THEN 'L2' ELSE 'L1' END AS layer,
 'https://rpc' || CAST(c_custkey AS STRING) || '.example.com' AS rpc_urls, 'c' || CAST(c_custkey AS STRING) || '.example.org' AS domains FROM customer""",
)
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    raw = _raw(
        _cust(spark, sf), F.lit("ethereum_lists"), chainId=F.col("c_custkey"), name=F.concat(F.lit("Net "), k, F.when(F.col("c_custkey") % 3 == 1, F.lit(" Sepolia")).otherwise(F.lit(""))),
        rpc=F.array(F.concat(F.lit("https://rpc"), k, F.lit(".example.com")), F.lit("wss://ws.example.com")), infoURL=F.concat(F.lit("https://www.c"), k, F.lit(".example.org/")),
        status=F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("incubating"), parent=F.when(F.col("c_custkey") % 2 == 0, F.struct(F.lit("L2").alias("type"))),
        explorers=F.array(F.struct(F.lit("https://scan.example.com").alias("url"))),
    )
    o = N.normalize_evm_chain_json(raw)
    return o.select("evidence_id", "caip2", "environment", "stage", "layer", F.array_join("rpc_urls", " ").alias("rpc_urls"), F.array_join("organization_domains", " ").alias("domains"))


@query(
    "cosmos_chain_definitions",
    "N3",
    """SELECT CAST(c_custkey AS STRING) AS evidence_id, c_name AS candidate_name, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN 'testnet' ELSE 'mainnet' END AS environment,
 'cosmos:' || CASE WHEN c_custkey % 5 = 0 THEN 'test-' ELSE 'main-' END || CAST(c_custkey AS STRING) AS caip2 FROM customer""",
)
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    raw = _raw(
        _cust(spark, sf), F.lit("cosmos_chain_registry"), chain_name=F.lower("c_name"), pretty_name=F.col("c_name"), network_type=F.when(F.col("c_custkey") % 2 == 0, "testnet").otherwise("mainnet"),
        chain_id=F.concat(F.when(F.col("c_custkey") % 5 == 0, "test-").otherwise("main-"), k), website=F.lit("https://osmo.example.zone"), apis=F.struct(F.array(F.struct(F.lit("https://rpc.example.zone").alias("address"))).alias("rpc")),
    )
    return N.normalize_cosmos_chain_json(raw).select("evidence_id", "candidate_name", "environment", "caip2")


_REPO = "CASE p_partkey % 6 WHEN 0 THEN 'A CometBFT testnet' WHEN 1 THEN 'Parachain l1 devnet' WHEN 2 THEN 'op-geth hyperchain mainnet' WHEN 3 THEN 'incentivized starknet' WHEN 4 THEN 'nitro node' ELSE 'plain rollup' END"


@query(
    "repositories",
    "N4",
    f"""SELECT CAST(p_partkey AS STRING) AS evidence_id, ['cosmos', 'substrate', 'evm', 'starknet', 'evm', 'evm'][p_partkey % 6 + 1] AS stack_family, ['cosmos_sdk', 'polkadot_sdk', 'op_stack', NULL, 'arbitrum_orbit', NULL][p_partkey % 6 + 1] AS stack_details,
 ['L2', 'L1', 'L3', 'L2', 'L2', 'L2'][p_partkey % 6 + 1] AS layer, ['S2_public_testnet', 'S1_devnet_prototype', 'S4_mainnet_announced', 'S3_incentivized_testnet', 'S1_devnet_prototype', 'S1_devnet_prototype'][p_partkey % 6 + 1] AS stage, p_brand AS owner FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("external_id", F.col("p_partkey")).withColumn("observed_at", F.timestamp_seconds("p_partkey"))
    raw = _raw(p, F.lit("github_hyper_search"), name=F.concat(F.lit("repo-"), F.col("p_partkey").cast("string")), description=F.expr(_REPO), owner=F.col("p_brand"), topics=F.array(F.lit("web3")))
    return N.normalize_repos(raw).select("evidence_id", "stack_family", "stack_details", "layer", "stage", F.get("github_orgs", F.lit(0)).alias("owner"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _pages(spark, sf):
    return table(spark, sf, "pages").withColumn("external_id", F.col("page_id")).withColumn("observed_at", F.timestamp_seconds("page_id")).withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))


@query(
    "feed_entries",
    "N5",
    f"""WITH p AS (SELECT page_id, url, trim(split_part(split_part({_TITLE} || ' on Conduit', ' on ', 1), ' - ', 1)) AS nm, lower({_TITLE} || html) LIKE '%mainnet%' AS main FROM pages)
SELECT CAST(page_id AS STRING) AS evidence_id, CASE WHEN len(nm) >= 2 THEN nm ELSE 'RaaS Announced Chain' END AS candidate_name, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain, CASE WHEN main THEN 'mainnet' ELSE 'testnet' END AS environment FROM p""",
)
def _(spark, sf):
    raw = _raw(_pages(spark, sf), F.lit("rss_sitemaps"), title=F.concat(F.lit("Announcing "), "title", F.lit(" on Conduit")), summary=F.col("html"), link=F.col("url"), feed_name=F.lit("f"))
    return N.normalize_feed_entries(raw).select("evidence_id", "candidate_name", F.get("organization_domains", F.lit(0)).alias("domain"), "environment")


@query(
    "search_results",
    "N6",
    f"SELECT CAST(page_id AS STRING) AS evidence_id, trim(split_part(split_part({_TITLE} || ' | Site', ' - ', 1), ' | ', 1)) AS candidate_name, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain FROM pages",
)
def _(spark, sf):
    raw = _raw(_pages(spark, sf), F.lit("web_news_search"), title=F.concat("title", F.lit(" | Site")), description=F.lit(""), url=F.col("url"))
    return N.normalize_search_results(raw).select("evidence_id", "candidate_name", F.get("organization_domains", F.lit(0)).alias("domain"))


@query(
    "job_postings",
    "N7",
    """SELECT CAST(o_orderkey AS STRING) AS evidence_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 THEN 0.6 ELSE 0.2 END::DOUBLE AS signal_strength,
 CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Kenya' ELSE 'Lagos, Niger, Nigeria' END WHEN 1 THEN 'EMEA' ELSE 'Berlin' END AS geography FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    raw = _raw(
        _orders(spark, sf), F.lit("ats_job_boards"), org_name=F.concat(F.lit("Org "), F.col("o_custkey").cast("string")), title=F.when(k % 2 == 0, "Head of Community").otherwise("Accountant"),
        location=F.when(k % 3 == 0, F.when(k % 5 == 0, "Remote ke").otherwise("Lagos, Nigeria")).when(k % 3 == 1, "EMEA").otherwise("Berlin"), url=F.lit("https://jobs.example.com/1"),
    )
    o = N.normalize_job_postings(raw, default_lexicon(spark), countries_dim(spark))
    return o.select("evidence_id", F.col("opportunities")[0]["signal_strength"].alias("signal_strength"), F.col("opportunities")[0]["geography"].alias("geography"))


@query(
    "social_posts",
    "N8",
    "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS evidence_id, regexp_extract(text, '^\\s*(\\S+)', 1) AS candidate_name, role AS author FROM conversations",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("external_id", F.concat_ws("-", "conv_id", "turn")).withColumn("observed_at", F.timestamp_seconds("turn"))
    return N.normalize_posts(_raw(c, F.lit("bluesky_jetstream"), text=F.col("text"), author=F.col("role"))).select("evidence_id", "candidate_name", F.col("claims")["social_author"].alias("author"))


_STAGE9 = "CASE c_custkey % 4 WHEN 0 THEN 'S2_public_testnet' WHEN 1 THEN 'S4_mainnet_announced' WHEN 2 THEN 'S5_early_mainnet' ELSE 'S1_devnet_prototype' END"


@query(
    "funded_registry",
    "N9",
    f"""SELECT CAST(c_custkey AS STRING) AS evidence_id, 'evm:net-' || CAST(c_custkey AS STRING) AS caip2, {_STAGE9} AS stage, CASE c_custkey % 4 WHEN 0 THEN 'testnet_announced_at' WHEN 1 THEN 'mainnet_announced_for' WHEN 2 THEN 'mainnet_live_at' END AS dated_claim FROM customer""",
)
def _(spark, sf):
    raw = _raw(
        _cust(spark, sf), F.lit("recent_funded_chains"), name=F.col("c_name"), slug=F.concat(F.lit("net-"), F.col("c_custkey").cast("string")), stage=F.expr(_STAGE9), stack_family=F.lit("EVM"),
        funding=F.struct(F.lit("2025-08-01T00:00:00Z").alias("announced_at")),
    )
    o = N.normalize_funded_registry(raw)
    dated = F.get(F.filter(F.array(*[F.lit(x) for x in ("testnet_announced_at", "mainnet_announced_for", "mainnet_live_at")]), lambda x: F.map_contains_key("claims", x)), F.lit(0))
    return o.select("evidence_id", "caip2", "stage", dated.alias("dated_claim"))


@query(
    "scaling_summaries",
    "N10",
    "SELECT CAST(c_custkey AS STRING) AS evidence_id, CASE c_custkey % 3 WHEN 0 THEN 'starknet' WHEN 1 THEN 'cosmos' ELSE 'evm' END AS stack_family, CASE WHEN c_custkey % 2 = 0 THEN 'L2' ELSE 'L3' END AS layer FROM customer",
)
def _(spark, sf):
    raw = _raw(_cust(spark, sf), F.lit("indexer_changelogs"), name=F.col("c_name"), type=F.when(F.col("c_custkey") % 2 == 0, "layer2").otherwise("layer3"), provider=F.when(F.col("c_custkey") % 3 == 0, "StarkWare").when(F.col("c_custkey") % 3 == 1, "Cosmos SDK").otherwise("OP Stack"))
    return N.normalize_scaling_summary(raw).select("evidence_id", "stack_family", "layer")


@query(
    "all_observations",
    "SO1",
    f"SELECT {_PR_SOURCE} AS source_id, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'rss_sitemaps', count(*) FROM pages UNION ALL SELECT 'bluesky_jetstream', count(*) FROM conversations",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("external_id", F.concat_ws("-", "conv_id", "turn")).withColumn("observed_at", F.timestamp_seconds("turn"))
    feeds = _raw(_pages(spark, sf), F.lit("rss_sitemaps"), title=F.col("title"), summary=F.lit(""), link=F.col("url"), feed_name=F.lit("f"))
    posts = _raw(c, F.lit("bluesky_jetstream"), text=F.col("text"), author=F.col("role"))
    all_obs = N.union_observations(N.normalize_registry_prs(_pr_raw(spark, sf)), N.normalize_feed_entries(feeds), N.normalize_posts(posts))
    return all_obs.groupBy("source_id").agg(F.count("*").alias("n"))


# -- exports ---------------------------------------------------------------------------------------


@query(
    "export_rows",
    "S8 S9",
    _ALL + f"""SELECT candidate_id AS id, canonical_name AS name, coalesce(layer, 'L2') AS layer, intent_label AS africa_intent, round(coalesce(total_funding_usd, 0), 2) AS total_funding_usd,
 (SELECT arg_max(round_type, row(coalesce(announced_at, TIMESTAMP '1900-01-01'), -round_id)) FROM rounds r WHERE r.candidate_id = joined.candidate_id) AS latest_round_type, state, workflow_state, {sql_t('first_seen_at')} AS first_seen_at,
 coalesce({sql_t('last_verified_at')}, '') AS last_verified_at FROM joined ORDER BY {_ORDER} LIMIT 500""",
)
def _(spark, sf):
    parts = [role(spark, sf, n) for n in ("candidates", "snapshots", "assessments", "rounds")]
    q = Q.candidate_queue(*parts, limit=TB.EXPORT_LIMIT).withColumn("organization", F.lit(None).cast("string"))
    out = TB.export_rows(q, parts[3])
    return out.select("id", "name", "layer", "africa_intent", r("total_funding_usd", 2).alias("total_funding_usd"), "latest_round_type", "state", "workflow_state", "first_seen_at", "last_verified_at")


@query(
    "export_json",
    "S9",
    _ALL + f"""SELECT CAST(candidate_id AS STRING) AS id, canonical_name AS name, slug, stage, stack_family, round(outreach_score, 6) AS outreach_score, round(radar_score, 6) AS radar_score,
 intent_label AS africa_intent, strftime(first_seen_at, '%Y-%m-%d %H:%M') AS first_seen_minute FROM joined ORDER BY {_ORDER} LIMIT 500""",
)
def _(spark, sf):
    """The nine-column export written as JSON and read back."""
    from winnow.plans.ledger import _scratch

    parts = [role(spark, sf, n) for n in ("candidates", "snapshots", "assessments", "rounds")]
    q = Q.candidate_queue(*parts, limit=TB.EXPORT_LIMIT).withColumn("organization", F.lit(None).cast("string"))
    path = _scratch(spark)
    TB.export_candidates(TB.export_rows(q, parts[3]), path, "json")
    back = spark.read.schema("id string, name string, slug string, stage string, stack_family string, outreach_score double, radar_score double, africa_intent string, first_seen_at string").json(path)
    return back.select("id", "name", "slug", "stage", "stack_family", r("outreach_score").alias("outreach_score"), r("radar_score").alias("radar_score"), "africa_intent", F.substring("first_seen_at", 1, 16).alias("first_seen_minute"))


@query(
    "loaded_lexicon",
    "S3",
    """WITH f AS (SELECT n_name AS entity, unnest(list_distinct([n_name, lower(n_name) || ' land', n_name || 'ian'])) AS term FROM nation)
SELECT 'country' AS kind, entity, term, EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 5 = 0 AND lower(n_name) = lower(term)) AS ambiguous FROM f
UNION ALL SELECT 'hub', n_name, 'City ' || CAST(n_nationkey AS STRING), FALSE FROM nation
UNION ALL SELECT 'currency', 'CUR' || CAST(n_nationkey AS STRING), 'CUR' || CAST(n_nationkey AS STRING), FALSE FROM nation
UNION ALL SELECT 'region', r_name, r_name, FALSE FROM region
UNION ALL SELECT 'bloc', r_name, unnest([r_name, 'Union of ' || r_name]), FALSE FROM region""",
)
def _(spark, sf):
    """Lexicon files made of nations and regions, with aliases, demonyms and ambiguous forms, and read back."""
    from winnow.plans.ledger import _scratch
    from winnow.sources.lexicon import load_lexicon

    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    path, none = _scratch(spark), F.array().cast("array<string>")
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    country = F.struct(name.alias("name"), F.array(F.concat(F.lower(name), F.lit(" land"))).alias("aliases"), F.array(F.concat(name, F.lit("ian"))).alias("demonyms"), F.when(F.col("n_nationkey") % 5 == 0, F.array(name)).otherwise(none).alias("ambiguous_aliases"))
    hub, cur = F.struct(F.concat(F.lit("City "), key).alias("city"), name.alias("country")), F.struct(F.concat(F.lit("CUR"), key).alias("code"))
    by_name = lambda v: F.map_from_entries(F.collect_list(F.struct("r_name", v)))
    files = {
        "countries": nation.agg(F.collect_list(country).alias("countries")),
        "hubs_and_rails": nation.agg(F.collect_list(hub).alias("priority_hubs"), F.collect_list(cur).alias("currencies"), F.max(none).alias("payment_rails")),
        "regions_and_blocs": region.agg(by_name(none).alias("regions"), by_name(F.struct(F.array(F.concat(F.lit("Union of "), "r_name")).alias("aliases"))).alias("economic_blocs")),
        "languages": nation.agg(F.max(F.lit(None).cast("string")).alias("languages")),
        "intent_keywords": nation.agg(F.max(F.lit(None).cast("string")).alias("intent_packs")),
    }
    for file, df in files.items():
        df.coalesce(1).write.json(f"{path}/{file}.json")
    return load_lexicon(spark, path).filter("kind NOT IN ('pan', 'use_case')").select("kind", "entity", "term", "ambiguous")


# -- backtest --------------------------------------------------------------------------------------


def corpus(spark, sf):
    """Customers as fixtures: three quarters are real projects, the rest token launches."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    pos = k % 4 != 0
    ev = lambda *xs: F.array(*[F.struct(F.lit(f).alias("family"), F.lit(d).alias("day_offset")) for f, d in xs])
    start = F.lit("2026-01-01 00:00:00").cast("timestamp") + F.expr("interval 1 day") * (k % 28)
    text = F.when(k % 2 == 0, F.concat(F.lit("Chain "), "c_name", F.lit(" opened its test network; a hackathon in Lagos, Nigeria begins the africa expansion."))).otherwise(F.concat("c_name", F.lit(" moves remittance volume in a stablecoin on its beta main network.")))
    return c.select(
        F.col("c_name").alias("name"), k.alias("ordinal"), pos.alias("is_positive"), start.alias("first_eligible_signal"),
        F.when(pos, F.lit("2026-06-01 00:00:00").cast("timestamp") + F.expr("interval 1 day") * (k % 28)).alias("mainnet_live_at"),
        F.when(pos, text).otherwise("Buy at presale price, token address 0xfeed.").alias("sample_text"),
        F.when(pos & (k % 2 == 0), "A1_explicit_intent").when(pos, "A3_africa_compatible").alias("expected_label"),
        pos.alias("verified_genesis"), pos.alias("has_domain"), pos.alias("has_repo"),
        F.when(~pos, "S0_research_hint").when(k % 2 == 0, "S2_public_testnet").otherwise("S4_mainnet_announced").alias("stage"),
        F.when(pos, (k + 70000).cast("string")).alias("chain_id"), (~pos).alias("is_token_only"),
        F.when(pos, ev(("registry", 0), ("official_web", 2), ("code_search", 5), ("careers", 9))).otherwise(ev(("social", 0), ("market", 1))).alias("events"),
    )


def _cutoffs(spark, first, last, step):
    return spark.sql(f"SELECT explode(sequence(timestamp'{first}', timestamp'{last}', interval {step} days)) AS cutoff")


@query(
    "fixture_events",
    "B1",
    """WITH f(pos, fam, d) AS (VALUES (TRUE, 'registry', 0), (TRUE, 'official_web', 2), (TRUE, 'code_search', 5), (TRUE, 'careers', 9), (FALSE, 'social', 0), (FALSE, 'market', 1))
SELECT c_name AS candidate_id, fam AS source_family, strftime(TIMESTAMP '2026-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 28 + d), '%Y-%m-%d %H:%M:%S') AS observed_at FROM customer, f WHERE pos = (c_custkey % 4 <> 0)""",
)
def _(spark, sf):
    return B.fixture_events(corpus(spark, sf)).select("candidate_id", "source_family", t("observed_at").alias("observed_at"))


_REPLAYED = ("2026-01-10 00:00:00", "2026-01-25 00:00:00", "2026-02-09 00:00:00")


def _replay_sql() -> str:
    """Fixtures, their evidence and text features as of each cutoff, then the scores of each cutoff."""
    cuts = ", ".join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(_REPLAYED))
    start = f"""WITH fx AS (SELECT c_name AS name, c_custkey AS k, c_custkey % 4 <> 0 AS pos, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 28) AS first_at FROM customer),
cuts AS (SELECT * FROM (VALUES {cuts}) t(i, cutoff)),
offsets AS (SELECT * FROM (VALUES (TRUE, 'registry', 0), (TRUE, 'official_web', 2), (TRUE, 'code_search', 5), (TRUE, 'careers', 9), (FALSE, 'social', 0), (FALSE, 'market', 1)) t(p, fam, d)),
evidence AS (SELECT name AS candidate_id, k, fam || '_source' AS source_id, fam AS source_family, first_at + INTERVAL '1' DAY * d AS observed_at FROM fx JOIN offsets ON p = pos),
visible AS (SELECT k, i, bool_or(source_family IN ('registry', 'official_web')) AS official, bool_or(source_family IN ('code_search', 'careers', 'official_web', 'registry')) AS active
  FROM evidence, cuts WHERE observed_at <= cutoff GROUP BY 1, 2),
docs AS (SELECT visible.k * 10 + i AS doc_id, CASE WHEN NOT pos THEN 'Buy at presale price, token address 0xfeed.'
    WHEN visible.k % 2 = 0 THEN 'Chain ' || name || ' opened its test network; a hackathon in Lagos, Nigeria begins the africa expansion.'
    ELSE name || ' moves remittance volume in a stablecoin on its beta main network.' END AS text, official AS is_official_source, CAST(NULL AS BOOLEAN) AS has_local_team,
  CASE WHEN pos THEN TRUE END AS has_public_contact, CASE WHEN active THEN TRUE END AS has_funding_or_activity FROM visible JOIN fx ON fx.k = visible.k),
lex AS""" + FEATURES_SQL.split("\nlex AS", 1)[1]
    # Rounds the shortest decimal form of a double, half up.
    exact = lambda c: f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE)"
    one = []
    for i, c in enumerate(_REPLAYED):
        users = f"""users AS (SELECT name AS candidate_id, pos AS has_domain, pos AS has_repo, FALSE AS has_social, CAST(NULL AS TIMESTAMP) AS registry_pr_opened_at, CAST(NULL AS TIMESTAMP) AS registry_merged_at,
  pos AS advancing_liveness, pos AS verified_genesis, pos AS has_fingerprint, pos AS has_rpc, pos AS has_testnet, CAST(NULL AS TIMESTAMP) AS mainnet_live_at, CAST(NULL AS TIMESTAMP) AS testnet_announced_at,
  CASE WHEN pos AND k % 2 <> 0 THEN TIMESTAMP '2026-06-01 00:00:00' + INTERVAL '1' DAY * (k % 28) END AS mainnet_announced_for, NOT pos AS hard_blocked, CAST(0 AS DOUBLE) AS risk,
  CASE WHEN NOT pos THEN 'S0_research_hint' WHEN k % 2 = 0 THEN 'S2_public_testnet' ELSE 'S4_mainnet_announced' END AS stage, label, total AS fit
  FROM feat JOIN fx ON fx.k * 10 + {i} = feat.doc_id)"""
        one.append(
            f"SELECT * FROM (WITH {users},\n{scored_sql(c)} SELECT candidate_id AS name, '{c[:10]}' AS cutoff, state, {exact('conf')} AS confidence, {exact('outreach')} AS outreach_score, "
            f"{exact('radar')} AS radar_score, label, fit FROM scored WHERE latest IS NOT NULL)"
        )
    return start + "\n" + "\nUNION ALL ".join(one)


@query("backtest_replay", "B2", _replay_sql())
def _(spark, sf):
    res = B.replay(corpus(spark, sf), default_lexicon(spark), _cutoffs(spark, "2026-01-10 00:00:00", "2026-02-10 00:00:00", 15), unicode="native")
    return res.select("name", F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "state", "confidence", "outreach_score", "radar_score", "label", "fit")


@query("backtest_report", "B2 B3")
def _(spark, sf):
    res = B.replay(corpus(spark, sf), default_lexicon(spark), _cutoffs(spark, "2026-02-10 00:00:00", "2026-02-10 00:00:00", 1), unicode="native")
    return B.backtest_metrics(res)


_RUN = """WITH res AS (SELECT o_custkey AS name, date_trunc('month', o_orderdate) AS cutoff, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
r AS (SELECT *, name % 4 <> 0 AS is_positive, name AS ordinal, CASE k % 3 WHEN 0 THEN 'HOT' WHEN 1 THEN 'RADAR' ELSE 'QUALIFIED' END AS state, CAST(k % 97 AS DOUBLE) AS radar_score,
  CASE k % 5 WHEN 0 THEN 'A1_explicit_intent' WHEN 1 THEN 'A2_active_regional_motion' ELSE 'A4_no_evidence' END AS label, CASE name % 3 WHEN 0 THEN 'A1_explicit_intent' ELSE 'A3_africa_compatible' END AS expected_label,
  CASE WHEN k % 6 <> 0 THEN CAST(k % 200 AS DOUBLE) END AS lead_time_days, CASE WHEN k % 2 = 0 THEN '' ELSE 'social' END AS ablation FROM res)
"""


def _results(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("cutoff")).agg(F.max("o_orderkey").alias("k"))
    return o.selectExpr(
        "name", "cutoff", "k", "name % 4 <> 0 AS is_positive", "name AS ordinal", "CASE k % 3 WHEN 0 THEN 'HOT' WHEN 1 THEN 'RADAR' ELSE 'QUALIFIED' END AS state", "CAST(k % 97 AS DOUBLE) AS radar_score",
        "CASE k % 5 WHEN 0 THEN 'A1_explicit_intent' WHEN 1 THEN 'A2_active_regional_motion' ELSE 'A4_no_evidence' END AS label", "CASE name % 3 WHEN 0 THEN 'A1_explicit_intent' ELSE 'A3_africa_compatible' END AS expected_label",
        "CASE WHEN k % 6 <> 0 THEN CAST(k % 200 AS DOUBLE) END AS lead_time_days", "CASE WHEN k % 2 = 0 THEN '' ELSE 'social' END AS ablation",
    )


_METRICS = """SELECT {k}, count(*) AS total_evaluated, count(*) FILTER (WHERE is_positive) AS detected_positives, count(*) FILTER (WHERE is_positive AND state <> 'RADAR') AS promoted_positives, count(*) FILTER (WHERE NOT is_positive AND state <> 'RADAR') AS false_promotions,
 coalesce(count(*) FILTER (WHERE is_positive AND state <> 'RADAR')::DOUBLE / nullif(count(*) FILTER (WHERE is_positive), 0), 0) AS positive_recall, coalesce(count(*) FILTER (WHERE is_positive AND label < 'A3' AND expected_label < 'A3')::DOUBLE / nullif(count(*) FILTER (WHERE is_positive AND label < 'A3'), 0), 1) AS label_precision,
 median(lead_time_days) FILTER (WHERE is_positive) AS median_lead_time_days, avg(CASE WHEN is_positive THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE rk <= 20) AS precision_at_20
 FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY radar_score DESC, ordinal) AS rk FROM r) GROUP BY {k}"""


@query(
    "backtest_metrics",
    "B3",
    _RUN + f"SELECT strftime(cutoff, '%Y-%m') AS cutoff, total_evaluated, promoted_positives, false_promotions, round(positive_recall, 6) AS positive_recall, round(precision_at_20, 6) AS precision_at_20, round(label_precision, 6) AS label_precision, median_lead_time_days FROM ({_METRICS.format(k='cutoff')})",
)
def _(spark, sf):
    m = B.backtest_metrics(_results(spark, sf))
    return m.select(F.date_format("cutoff", "yyyy-MM").alias("cutoff"), "total_evaluated", "promoted_positives", "false_promotions", *[r(c).alias(c) for c in ("positive_recall", "precision_at_20", "label_precision")], "median_lead_time_days")


def _sweep_corpus(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS name", "c_custkey % 4 <> 0 AS is_positive", "TIMESTAMP '1995-01-01 00:00:00' - INTERVAL '1' DAY * (c_custkey % 40) AS first_eligible_signal",
        "CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '1996-01-01 06:00:00' + INTERVAL '1' DAY * (c_custkey % 90) END AS mainnet_live_at",
    )


@query(
    "cutoff_sweep",
    "B4",
    _RUN + """, f AS (SELECT name, min(cutoff) AS p FROM r WHERE state <> 'RADAR' GROUP BY 1),
c AS (SELECT c_custkey, c_custkey % 4 <> 0 AS pos, p, CASE WHEN c_custkey % 4 <> 0 THEN floor((epoch(p) - epoch(TIMESTAMP '1995-01-01 00:00:00' - INTERVAL '1' DAY * (c_custkey % 40))) / 86400) END AS lag,
  CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN floor((epoch(TIMESTAMP '1996-01-01 06:00:00' + INTERVAL '1' DAY * (c_custkey % 90)) - epoch(p)) / 86400) END AS lead FROM customer LEFT JOIN f ON name = c_custkey)
SELECT round(count(p) FILTER (WHERE pos)::DOUBLE / count(*) FILTER (WHERE pos), 6) AS positive_recall, round(count(p) FILTER (WHERE NOT pos)::DOUBLE / count(*) FILTER (WHERE NOT pos), 6) AS false_promotion_rate,
 median(lag)::DOUBLE AS median_time_to_discovery_days, median(lead)::DOUBLE AS median_lead_days, (list_sort(list(lag) FILTER (WHERE lag IS NOT NULL)))[CAST(floor(0.9 * (count(lag) - 1)) AS BIGINT) + 1]::DOUBLE AS p90_time_to_discovery_days FROM c""",
)
def _(spark, sf):
    s = B.cutoff_sweep(_results(spark, sf), _sweep_corpus(spark, sf))
    return s.select(r("positive_recall").alias("positive_recall"), r("false_promotion_rate").alias("false_promotion_rate"), "median_time_to_discovery_days", "median_lead_days", "p90_time_to_discovery_days")


@query("detected_fixtures", "SO2", _RUN + "SELECT c_custkey AS name FROM customer INTERSECT SELECT name FROM r WHERE state <> 'RADAR'")
def _(spark, sf):
    return B.detected(_sweep_corpus(spark, sf), _results(spark, sf)).select("name")


@query(
    "source_ablation",
    "B5",
    _RUN + f""", m AS ({_METRICS.format(k='cutoff, ablation')})
SELECT strftime(a.cutoff, '%Y-%m') AS cutoff, a.ablation AS family, round(a.positive_recall, 6) AS recall_without, round(b.positive_recall - a.positive_recall, 6) AS recall_delta, a.detected_positives AS detected_positives_without FROM m a JOIN m b ON a.cutoff = b.cutoff AND b.ablation = '' WHERE a.ablation <> ''""",
)
def _(spark, sf):
    a = B.source_ablation(_results(spark, sf))
    return a.select(F.date_format("cutoff", "yyyy-MM").alias("cutoff"), "family", r("recall_without").alias("recall_without"), r("recall_delta").alias("recall_delta"), "detected_positives_without")


# -- streams ---------------------------------------------------------------------------------------


def _stream(spark, sf, cols):
    """The events table as a stream of one file."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def _run(df, mode="append"):
    """Run a stream over all its input and return what it wrote: a table in the shared folder.

    A batch has its own part of the table and overwrites it when it is replayed.
    """
    from winnow.plans.ledger import _scratch

    base = _scratch(df.sparkSession)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def _ev_cols():
    from winnow.plans.roles import ROLES

    return {**ROLES["evidence"][1], "content_hash": "sha2(props, 256)"}


@query(
    "stream_evidence_dedup",
    "T1 T2",
    cte("evidence") + "SELECT DISTINCT source_id, content_hash, observed_bucket FROM evidence",
)
def _(spark, sf):
    from winnow.streaming.ingest import stream_evidence

    return _run(stream_evidence(_stream(spark, sf, _ev_cols()))).select("source_id", "content_hash", "observed_bucket")


@query(
    "stream_buckets",
    "T3",
    cte("evidence") + "SELECT strftime(date_trunc('hour', observed_at), '%Y-%m-%d %H:%M:%S') AS bucket, source_id, count(*) AS n FROM evidence GROUP BY 1, 2",
)
def _(spark, sf):
    from winnow.streaming.ingest import stream_buckets

    out = _run(stream_buckets(_stream(spark, sf, _ev_cols())), "update")
    return out.groupBy(t("window.start").alias("bucket"), "source_id").agg(F.max("n").alias("n"))


@query(
    "stream_velocity",
    "T4",
    cte("evidence") + """, w AS (SELECT candidate_id, unnest(generate_series(date_trunc('day', observed_at) - INTERVAL 13 DAY, date_trunc('day', observed_at), INTERVAL 1 DAY)) AS s FROM evidence)
SELECT strftime(s, '%Y-%m-%d') AS window_start, candidate_id, count(*) AS n FROM w GROUP BY 1, 2""",
)
def _(spark, sf):
    from winnow.streaming.ingest import stream_velocity

    out = _run(stream_velocity(_stream(spark, sf, _ev_cols())), "update")
    return out.groupBy(F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "candidate_id").agg(F.max("n").alias("n"))


@query(
    "stream_alert_dedup",
    "T5 U2",
    """WITH RECURSIVE ev AS (SELECT DISTINCT user_id AS k, ts FROM events WHERE event_type = 'error'),
sent(k, ts) AS (SELECT k, min(ts) FROM ev GROUP BY 1 UNION ALL SELECT s.k, (SELECT min(e.ts) FROM ev e WHERE e.k = s.k AND e.ts > s.ts + INTERVAL 24 HOUR) FROM sent s WHERE s.ts IS NOT NULL)
SELECT CAST(k AS STRING) AS dedup_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sent_at FROM sent WHERE ts IS NOT NULL""",
)
def _(spark, sf):
    from winnow.streaming.state import stream_alerts, use_rocksdb

    use_rocksdb(spark)
    s = _stream(spark, sf, {"dedup_key": "CAST(user_id AS STRING)", "at": "CAST(ts AS TIMESTAMP)", "event_type": "event_type"}).filter("event_type = 'error'")
    return _run(stream_alerts(s)).select("dedup_key", t("sent_at").alias("sent_at"))


@query(
    "stream_probe_liveness",
    "T6 U2",
    cte("probes") + """, l AS (SELECT *, lag(success) OVER w AS ps, lag(block_height) OVER w AS ph, lag(identity_fingerprint) OVER w AS pf FROM probes WINDOW w AS (PARTITION BY endpoint_hash ORDER BY observed_at, probe_id))
SELECT probe_id, coalesce(success AND ps AND block_height > ph AND identity_fingerprint = pf, FALSE) AS live FROM l""",
)
def _(spark, sf):
    from winnow.plans.roles import ROLES
    from winnow.streaming.state import stream_liveness, use_rocksdb

    use_rocksdb(spark)
    return _run(stream_liveness(_stream(spark, sf, ROLES["probes"][1]))).select("probe_id", "live")


@query(
    "probe_liveness_batch",
    "T6 W2",
    cte("probes") + """, l AS (SELECT *, lag(success) OVER w AS ps, lag(block_height) OVER w AS ph, lag(identity_fingerprint) OVER w AS pf FROM probes WINDOW w AS (PARTITION BY endpoint_hash ORDER BY observed_at, probe_id))
SELECT probe_id, coalesce(success AND ps AND block_height > ph AND identity_fingerprint = pf, FALSE) AS live FROM l""",
)
def _(spark, sf):
    from winnow.functions.ordered import with_previous

    p = with_previous(role(spark, sf, "probes"), ["endpoint_hash"], "observed_at", ["probe_id"], ["success", "block_height", "identity_fingerprint"])
    live = F.col("success") & F.col("prev_success") & (F.col("block_height") > F.col("prev_block_height")) & (F.col("identity_fingerprint") == F.col("prev_identity_fingerprint"))
    return p.select("probe_id", F.coalesce(live, F.lit(False)).alias("live"))
