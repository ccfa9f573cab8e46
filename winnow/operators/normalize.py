"""Raw payloads to observations, one set-based job per payload shape.

Every job returns the same columns, so their union is the observation table. Registry pull requests
of all registries go through one job driven by a small rule table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.once import with_once
from winnow.functions.text import any_contains, caip2, domain
from winnow.operators.score import S0, S1, S2, S3, S4, S5

# Columns of an observation and their types.
OBSERVATION = {
    "source_id": "string", "evidence_id": "string", "observed_at": "timestamp", "candidate_name": "string",
    "candidate_slug": "string", "organization_name": "string", "organization_domains": "array<string>",
    "github_orgs": "array<string>", "claimed_locations": "array<string>", "purpose_labels": "array<string>",
    "stack_family": "string", "stack_details": "string", "layer": "string", "environment": "string",
    "is_public": "boolean", "caip2": "string", "protocol_namespace": "string", "human_chain_id": "string",
    "rpc_urls": "array<string>", "explorer_urls": "array<string>", "faucet_urls": "array<string>",
    "genesis_fingerprint": "string", "stage": "string", "raw_text": "string", "claims": "map<string,string>",
    "contacts": "array<struct<role_type:string,channel_type:string,channel_value:string,permitted_purpose:string,source_url:string>>",
    "opportunities": "array<struct<opportunity_type:string,geography:string,summary:string,url:string,signal_strength:double>>",
    "reliability": "double",
}
# What a registry's pull requests look like. Columns: source, words deleted from the
# title, fallback name, chain-id pattern, explorer words, base stage, stack family, stack words
# (word: family), details, layer, reliability, dates kept, extra claims.
ID_CAMEL, ID_SNAKE, ID_TEXT = r"(?i)chainId[:\s=]+(\d+)", r"(?i)chain_id[:\s=]+(\d+)", r"(?i)chain_id[:\s=]+([\w-]+)"
PR_RULES = (
    ("ethereum_lists", "Add|add|Chain:|chain:", "Chain PR #", ID_CAMEL, "explorer|scan", S1, "evm", (), None, None, 0.90, True, ()),
    ("superchain_registry", "Add|add|chain|Chain", "OP Superchain PR #", ID_SNAKE, "explorer|scan", S2, "evm", (), "op_stack", "L2", 0.95, True, (("superchain_level", "standard"),)),
    ("blockscout_chainscout", "Add|add|chain", "Chainscout PR #", ID_CAMEL, "explorer|scan|blockscout", S2, "evm", (), None, None, 0.85, False, ()),
    ("axelar_configs", "Add|add|chain", "Axelar PR #", ID_CAMEL, "explorer|scan", S2, "evm", (("cosmos", "cosmos"),), None, None, 0.85, False, (("interoperability", "axelar"),)),
    ("hyperlane_registry", "Add|add|chain|metadata", "Hyperlane PR #", ID_CAMEL, "explorer|scan", S2, "evm", (("sealevel", "svm"), ("solana", "svm"), ("cosmos", "cosmos")), None, None, 0.88, False, (("interoperability", "hyperlane"),)),
    ("cosmos_chain_registry", "Add|add|chain", "Cosmos PR #", ID_TEXT, "explorer|mintscan", S2, "cosmos", (), "cosmos_sdk", "L1", 0.92, True, ()),
    ("caip_namespaces", "Add|add|namespace", "CAIP Namespace PR #", None, None, S0, "custom", (), None, None, 0.90, False, ()),
)
# Keyword rules for repositories, tried in order: words, family, details.
REPO_STACKS = (
    (("cosmos-sdk", "cometbft", "tendermint", "cosmos"), "cosmos", "cosmos_sdk"),
    (("polkadot-sdk", "substrate", "cumulus", "parachain"), "substrate", "polkadot_sdk"),
    (("svm", "solana-validator", "agave"), "svm", None),
    (("starknet", "cairo"), "starknet", None),
    (("aptos", "sui", "move"), "move", None),
    (("fuel", "fuelvm", "fuel-core"), "fuel", None),
    (("op-stack", "op-geth", "optimism"), "evm", "op_stack"),
    (("arbitrum", "nitro"), "evm", "arbitrum_orbit"),
)
# Words of a job title that mark a relevant role.
JOB_ROLES = (
    "community|developer relations|devrel|ecosystem|growth|partnerships|business development|bd|country manager|"
    "regional lead|government relations|developer advocate|ambassador"
)
FEED_PREFIXES = ("Announcing ", "Introducing ", "Welcome ", "Launching ")


def observation(df: DataFrame, **cols: Column) -> DataFrame:
    """Project ``df`` onto the observation columns; what is not given is null or empty."""
    given = {"source_id": F.col("source_id"), "evidence_id": F.col("external_id"), "observed_at": F.col("observed_at"), "is_public": F.lit(True), **cols}

    def one(name: str, ty: str) -> Column:
        empty = F.array().cast(ty) if ty.startswith("array") else F.lit(None).cast(ty)
        c = given.get(name)
        if c is None:
            return empty.alias(name)
        return (F.coalesce(c.cast(ty), empty) if ty.startswith("array") else c.cast(ty)).alias(name)

    return df.select(*[one(n, ty) for n, ty in OBSERVATION.items()])


def union_observations(*parts: DataFrame) -> DataFrame:
    """One observation table from all jobs (SO1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _claims(*pairs: tuple[str, Column]) -> Column:
    """Map of the claims whose value is present."""
    entries = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in pairs])
    return F.map_from_entries(F.array_compact(entries))


def _live_stage(text: Column, base: Column) -> tuple[Column, Column]:
    """(environment, stage): text that names a mainnet announces one."""
    main = text.contains("mainnet")
    return F.when(main, "mainnet").otherwise("testnet"), F.when(main, S4).otherwise(base)


def normalize_registry_prs(raw: DataFrame) -> DataFrame:
    """Registry pull requests of all known registries."""
    spark = raw.sparkSession
    rules = spark.createDataFrame(
        [
            (s, strip, prefix, rx or "(?!)(.)", ex or "(?!)", st, fam, [w for w, _ in words], [f for _, f in words], det, lay, rel, dates, dict(extra))
            for s, strip, prefix, rx, ex, st, fam, words, det, lay, rel, dates, extra in PR_RULES
        ],
        "source_id string, strip string, prefix string, id_rx string, ex string, base string, family string, words array<string>, "
        "families array<string>, details string, layer string, reliability double, dates boolean, extra map<string,string>",
    )
    df = raw.join(rules, "source_id").withColumn(
        "p", F.from_json("payload", "pr_number string, title string, body string, created_at string, merged_at string, user string")
    )
    title, body = F.coalesce("p.title", F.lit("")), F.coalesce("p.body", F.lit(""))
    df = with_once(df, _text=F.concat(title, F.lit("\n"), body), _title=title)
    url = lambda words: F.concat(F.lit("(?i)https?://[^\\s<>\"']+(?:"), words, F.lit(")[^\\s<>\"']*"))
    found = lambda words: F.array_sort(F.array_distinct(F.regexp_extract_all("_text", url(words), F.lit(0))))
    word_at = F.filter(F.arrays_zip(F.col("words").alias("w"), F.col("families").alias("f")), lambda x: F.lower("_text").contains(x["w"]))
    df = with_once(
        df,
        _low=F.lower("_text"),
        _name=F.trim(F.substring_index(F.regexp_replace(F.col("_title"), F.col("strip"), F.lit("")), "(", 1)),
        _id=F.get(F.regexp_extract_all("_text", F.col("id_rx"), F.lit(1)), F.lit(0)),
        _rpc=F.when(F.col("ex") != "(?!)", found(F.lit("rpc|node"))),
        _exp=F.when(F.col("ex") != "(?!)", found(F.col("ex"))),
        _stack=F.coalesce(F.get(word_at, F.lit(0))["f"], F.col("family")),
    )
    caip = F.col("source_id") == "caip_namespaces"
    first_registry = F.col("source_id") == "ethereum_lists"
    base = F.when(first_registry & F.col("_low").contains("testnet"), S2).otherwise(F.col("base"))
    env, stage = _live_stage(F.col("_low"), base)
    name = F.when(F.length("_name") >= 2, F.col("_name")).otherwise(F.concat("prefix", F.coalesce("p.pr_number", F.lit("unknown"))))
    ns = F.when(F.col("_stack") == "evm", "eip155").otherwise(F.col("_stack"))
    claims = F.map_concat(
        _claims(
            ("pr_number", F.col("p.pr_number")),
            ("author", F.when(first_registry | (F.col("source_id") == "cosmos_chain_registry"), F.col("p.user"))),
            ("registry_pr_opened_at", F.when(F.col("dates"), F.col("p.created_at"))),
            ("registry_merged_at", F.when(F.col("dates"), F.col("p.merged_at"))),
        ),
        F.col("extra"),
    )
    return observation(
        df, candidate_name=name, stack_family=F.col("_stack"), stack_details=F.col("details"), layer=F.col("layer"),
        environment=F.when(caip, "devnet").otherwise(env), stage=F.when(caip, S0).otherwise(stage), human_chain_id=F.col("_id"),
        protocol_namespace=F.when(~caip, ns), caip2=F.when(F.col("_stack").isin("evm", "cosmos") & ((F.col("_stack") == "evm") | (F.col("family") == "cosmos")), caip2(ns, F.col("_id"))),
        rpc_urls=F.col("_rpc"), explorer_urls=F.col("_exp"), raw_text=F.col("_text"), claims=claims, reliability=F.col("reliability"),
    )


def _domains(url: Column) -> Column:
    return F.array_compact(F.array(domain(F.coalesce(url, F.lit("")))))


def normalize_evm_chain_json(raw: DataFrame, default_stage: str = S1) -> DataFrame:
    """EVM chain definitions (N2). ``default_stage`` is S2 for the aggregated list."""
    schema = (
        "chainId string, name string, chain string, rpc array<string>, explorers array<struct<url:string>>, faucets array<string>, "
        "infoURL string, status string, parent string"
    )
    df = raw.withColumn("p", F.from_json("payload", schema))
    name = F.coalesce(F.nullif(F.col("p.name"), F.lit("")), F.col("p.chain"), F.lit("Unknown Chain"))
    low = F.lower(name)
    main = (F.lower("p.status") == "active") | low.contains("mainnet")
    main = F.coalesce(main, F.lit(False))
    stage = F.when(main, S4).when(any_contains(low, ("testnet", "sepolia", "devnet")), S2).otherwise(default_stage)
    cid = F.nullif(F.col("p.chainId"), F.lit(""))
    return observation(
        df, candidate_name=name, organization_domains=_domains(F.col("p.infoURL")), stack_family=F.lit("evm"),
        layer=F.when(F.coalesce("p.parent", F.lit("")) != "", "L2").otherwise("L1"), environment=F.when(main, "mainnet").otherwise("testnet"), stage=stage,
        caip2=caip2(F.lit("eip155"), cid), protocol_namespace=F.lit("eip155"), human_chain_id=cid,
        rpc_urls=F.filter("p.rpc", lambda u: ~u.startswith("wss://")), explorer_urls=F.filter("p.explorers.url", lambda u: u.isNotNull() & (u != "")),
        faucet_urls=F.col("p.faucets"), raw_text=F.col("payload"), claims=_claims(("parent", F.col("p.parent"))), reliability=F.lit(0.90 if default_stage == S1 else 0.88),
    )


def normalize_cosmos_chain_json(raw: DataFrame) -> DataFrame:
    """Cosmos chain definitions."""
    schema = (
        "chain_name string, pretty_name string, chain_id string, network_type string, website string, codebase string, bech32_prefix string, "
        "apis struct<rpc:array<struct<address:string>>>, explorers array<struct<url:string>>"
    )
    df = raw.withColumn("p", F.from_json("payload", schema))
    cid = F.nullif(F.col("p.chain_id"), F.lit(""))
    test = F.coalesce(F.col("p.network_type") == "testnet", F.lit(False)) | F.coalesce(cid.contains("test"), F.lit(False))
    return observation(
        df, candidate_name=F.coalesce(F.nullif(F.col("p.pretty_name"), F.lit("")), F.col("p.chain_name"), F.lit("Unknown Cosmos Chain")),
        organization_domains=_domains(F.col("p.website")), stack_family=F.lit("cosmos"), stack_details=F.lit("cosmos_sdk"), layer=F.lit("L1"),
        environment=F.when(test, "testnet").otherwise("mainnet"), stage=F.when(test, S2).otherwise(S5), caip2=caip2(F.lit("cosmos"), cid),
        protocol_namespace=F.lit("cosmos"), human_chain_id=cid, rpc_urls=F.filter("p.apis.rpc.address", lambda u: u.isNotNull() & (u != "")),
        explorer_urls=F.filter("p.explorers.url", lambda u: u.isNotNull() & (u != "")), raw_text=F.col("payload"),
        claims=_claims(("codebase", F.col("p.codebase")), ("bech32_prefix", F.col("p.bech32_prefix"))), reliability=F.lit(0.92),
    )


def normalize_repos(raw: DataFrame) -> DataFrame:
    """Repositories (N4): ordered keyword rules for stack, layer and stage."""
    df = raw.withColumn(
        "p", F.from_json("payload", "name string, full_name string, description string, topics array<string>, homepage string, owner string, created_at string, pack_name string")
    )
    name = F.coalesce("p.name", F.lit("Unknown Repo"))
    text = F.concat_ws(" ", name, F.coalesce("p.description", F.lit("")), F.array_join(F.coalesce("p.topics", F.array().cast("array<string>")), " "))
    df = with_once(df, _text=text, _low=F.lower(text), _name=name)
    low = F.col("_low")

    def first(pairs, default) -> Column:
        out = None
        for words, value in pairs:
            cond = any_contains(low, words)
            v = F.lit(value).cast("string")
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out.otherwise(F.lit(default).cast("string"))

    owner = F.nullif(F.col("p.owner"), F.lit(""))
    return observation(
        df, candidate_name=F.col("_name"), organization_name=owner, organization_domains=_domains(F.col("p.homepage")), github_orgs=F.array_compact(F.array(owner)),
        stack_family=first([(w, f) for w, f, _ in REPO_STACKS], "evm"), stack_details=first([(w, d) for w, _, d in REPO_STACKS], None),
        layer=first([(("layer 1", "l1", "sovereign"), "L1"), (("layer 3", "l3", "hyperchain"), "L3")], "L2"),
        environment=first([(("mainnet",), "mainnet"), (("incentivized", "testnet"), "testnet")], "devnet"),
        stage=first([(("mainnet",), S4), (("incentivized",), S3), (("testnet",), S2)], S1),
        raw_text=F.col("_text"), reliability=F.lit(0.80),
        claims=_claims(("pack_name", F.col("p.pack_name")), ("github_repo", F.col("p.full_name")), ("repo_created_at", F.col("p.created_at"))),
    )


def _cut(text: Column, *marks: str) -> Column:
    for m in marks:
        text = F.substring_index(text, m, 1)
    return F.trim(text)


def _named(text: Column, fallback: str) -> Column:
    return F.when(F.length(text) >= 2, text).otherwise(fallback)


def normalize_feed_entries(raw: DataFrame) -> DataFrame:
    """Feed entries (N5): name from the title, domain from the link."""
    df = raw.withColumn("p", F.from_json("payload", "title string, summary string, link string, feed_name string"))
    title = F.coalesce("p.title", F.lit(""))
    name = title
    for prefix in FEED_PREFIXES:
        name = F.regexp_replace(name, f"^{prefix}", "")
    df = with_once(df, _name=_cut(name, " on ", " - "), _text=F.concat(title, F.lit("\n"), F.coalesce("p.summary", F.lit(""))))
    env, stage = _live_stage(F.lower("_text"), F.lit(S2))
    return observation(
        df, candidate_name=_named(F.col("_name"), "RaaS Announced Chain"), organization_domains=_domains(F.col("p.link")), stack_family=F.lit("evm"), layer=F.lit("L2"),
        environment=env, stage=stage, raw_text=F.col("_text"), claims=_claims(("raas_feed", F.col("p.feed_name"))), reliability=F.lit(0.85),
    )


def normalize_search_results(raw: DataFrame) -> DataFrame:
    """Web search results."""
    df = raw.withColumn("p", F.from_json("payload", "title string, description string, url string"))
    title = F.coalesce("p.title", F.lit(""))
    return observation(
        df, candidate_name=_named(_cut(title, " - ", " | "), "Discovered Web Candidate"), organization_domains=_domains(F.col("p.url")), stack_family=F.lit("evm"),
        environment=F.lit("testnet"), stage=F.lit(S0), raw_text=F.concat(title, F.lit("\n"), F.coalesce("p.description", F.lit(""))),
        claims=_claims(("web_url", F.col("p.url"))), reliability=F.lit(0.70),
    )


def normalize_job_postings(raw: DataFrame, lexicon: DataFrame, countries: DataFrame) -> DataFrame:
    """Job postings (N7): role and geography give the signal strength.

    Places are plain substrings of title and location, a country code must be a word of the
    location. Each distinct text is cut into its substrings of the lengths that places have and meets them by
    equality, so the list of places may have any size.
    """
    forms = lexicon.filter(F.col("kind").isin("country", "hub")).select(F.when(F.col("kind") == "hub", F.col("term")).otherwise(F.col("entity")).alias("place"), F.lower("term").alias("form")).filter("form <> ''")
    codes = countries.select(F.col("name").alias("place"), F.lower("iso2").alias("form"))
    df = raw.withColumn("p", F.from_json("payload", "org_name string, title string, location string, url string"))
    title, loc = F.coalesce("p.title", F.lit("")), F.coalesce("p.location", F.lit(""))
    df = with_once(df, _title=title, _loc=loc, _text=F.concat(title, F.lit(" "), loc), _low=F.lower(F.concat(title, F.lit(" "), loc)), _words=F.lower(loc))
    lengths = sorted(r[0] for r in forms.select(F.length("form").alias("n")).distinct().collect())  # no more than a name has characters
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.length("_low") - x + 1), lambda i: F.substring(F.col("_low"), i, x))
    parts = F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda x: x <= F.length("_low")), cut)))
    texts = df.select("_low", "_words").distinct()
    named = texts.select("_low", "_words", F.explode(parts).alias("form")).join(forms, "form")
    coded = texts.select("_low", "_words", F.explode(F.array_distinct(F.split("_words", r"\s+"))).alias("form")).join(codes, "form")
    places = named.unionByName(coded).groupBy("_low", "_words").agg(F.collect_set("place").alias("_places"))  # of one text
    df = df.join(places, ["_low", "_words"], "left")
    df = with_once(df, _geo=F.array_sort(F.coalesce("_places", F.array().cast("array<string>"))), _role=F.lower("_title").rlike(rf"(?<![\p{{L}}\p{{N}}_])({JOB_ROLES})(?![\p{{L}}\p{{N}}_])"))
    strength = F.when(F.col("_role") & (F.size("_geo") > 0), 1.0).when(F.col("_role") & any_contains(F.col("_low"), ("emea", "africa")), 0.6).otherwise(0.2)
    kind = F.when(any_contains(F.lower("_title"), ("bd", "manager")), "market_entry_bd").otherwise("developer_relations")
    url = F.coalesce("p.url", F.lit(""))
    opp = F.struct(
        kind.alias("opportunity_type"), F.when(F.size("_geo") > 0, F.array_join("_geo", ", ")).otherwise(F.col("_loc")).alias("geography"),
        F.concat(F.lit("Active hiring for "), "_title", F.lit(" (Location: "), "_loc", F.lit(")")).alias("summary"), url.alias("url"), strength.alias("signal_strength"),
    )
    contact = F.struct(
        F.lit("recruiting").alias("role_type"), F.lit("application_url").alias("channel_type"), url.alias("channel_value"),
        F.lit("careers_and_partnership").alias("permitted_purpose"), url.alias("source_url"),
    )
    org = F.coalesce("p.org_name", F.lit("Unknown Organization"))
    return observation(
        df, candidate_name=org, organization_name=org, stack_family=F.lit("evm"), environment=F.lit("testnet"), stage=F.lit(S1), raw_text=F.col("_text"),
        claims=_claims(("job_title", F.col("_title")), ("job_location", F.col("_loc")), ("signal_strength", strength), ("matched_geo", F.array_join("_geo", ", "))),
        opportunities=F.array(opp), contacts=F.array_compact(F.array(F.when(url != "", contact))), reliability=F.lit(0.80),
    )


def normalize_posts(raw: DataFrame) -> DataFrame:
    """Social posts (N8): first word as name, author as claim."""
    df = raw.withColumn("p", F.from_json("payload", "text string, author string"))
    text = F.coalesce("p.text", F.lit(""))
    word = F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)
    return observation(
        df, candidate_name=F.when(word != "", word).otherwise("Bluesky Discovered Chain"), stack_family=F.lit("evm"), environment=F.lit("testnet"), stage=F.lit(S0),
        raw_text=text, claims=_claims(("social_author", F.coalesce("p.author", F.lit("unknown_author")))), reliability=F.lit(0.50),
    )


def normalize_funded_registry(raw: DataFrame) -> DataFrame:
    """Curated registry of funded networks (N9): the funding date becomes stage-specific claims."""
    schema = (
        "name string, slug string, org_name string, domains array<string>, stack_family string, stack_details string, layer string, chain_id string, caip2 string, "
        "environment string, stage string, rpc_urls array<string>, explorer_urls array<string>, purpose_labels array<string>, claimed_locations array<string>, funding struct<announced_at:string>"
    )
    df = raw.withColumn("p", F.from_json("payload", schema))
    stack = F.lower(F.coalesce("p.stack_family", F.lit("evm")))
    stage = F.coalesce("p.stage", F.lit(S2))
    at = F.col("p.funding.announced_at")
    return observation(
        df, candidate_name=F.coalesce("p.name", F.lit("Unknown Chain")), candidate_slug=F.col("p.slug"), organization_name=F.col("p.org_name"), organization_domains=F.col("p.domains"),
        claimed_locations=F.col("p.claimed_locations"), purpose_labels=F.col("p.purpose_labels"), stack_family=F.when(stack.isin("evm", "cosmos", "substrate", "svm"), stack).otherwise("evm"),
        stack_details=F.col("p.stack_details"), layer=F.coalesce("p.layer", F.lit("L1")), environment=F.when(F.lower("p.environment") == "mainnet", "mainnet").otherwise("testnet"),
        caip2=F.coalesce(F.nullif(F.col("p.caip2"), F.lit("")), F.concat(stack, F.lit(":"), F.col("p.slug"))), human_chain_id=F.nullif(F.col("p.chain_id"), F.lit("")),
        rpc_urls=F.col("p.rpc_urls"), explorer_urls=F.col("p.explorer_urls"), stage=stage, reliability=F.lit(0.98),
        claims=_claims(
            ("first_seen_at", at), ("published_at", at), ("testnet_announced_at", F.when(stage.isin(S2, S3), at)), ("mainnet_announced_for", F.when(stage == S4, at)),
            ("mainnet_live_at", F.when(stage.startswith("S5") | stage.startswith("S6"), at)),
        ),
    )


def normalize_scaling_summary(raw: DataFrame) -> DataFrame:
    """Scaling-project summaries (N10): provider gives the stack, type the layer."""
    df = raw.withColumn("p", F.from_json("payload", "name string, slug string, type string, provider string, category string"))
    low = F.lower(F.coalesce("p.provider", F.lit("")))
    return observation(
        df, candidate_name=F.coalesce("p.name", F.lit("Unknown Scaling Project")), candidate_slug=F.col("p.slug"),
        stack_family=F.when(low.contains("stark"), "starknet").when(low.contains("cosmos"), "cosmos").otherwise("evm"), stack_details=F.col("p.provider"),
        layer=F.when(F.coalesce("p.type", F.lit("layer2")) == "layer2", "L2").otherwise("L3"), environment=F.lit("mainnet"), stage=F.lit(S5), raw_text=F.col("payload"),
        claims=_claims(("l2beat_provider", F.col("p.provider")), ("category", F.col("p.category"))), reliability=F.lit(0.90),
    )
