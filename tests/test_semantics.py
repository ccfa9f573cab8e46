"""Scenarios: resolution, classification, scoring, funding, verification, privacy, backtest, streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from winnow.operators import assess as A
from winnow.operators import backtest as B
from winnow.operators import funding as FU
from winnow.operators import geography as G
from winnow.operators import normalize as N
from winnow.operators import resolve as R
from winnow.operators import score as S
from winnow.operators import verify as V
from winnow.sources import tables as TB
from winnow.sources.lexicon import SCHEMA, countries_dim, default_lexicon, load_lexicon

T0 = datetime(2026, 1, 1)


def texts(spark, *items, **flags):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "doc_id long, text string")
    for k, v in flags.items():
        df = df.withColumn(k, F.lit(v))
    return df


def features(spark, text, **flags):
    return G.africa_features(texts(spark, text, **flags), default_lexicon(spark)).first()


# -- classification ------------------------------------------------------------------------------


def test_ambiguous_names_need_context(spark):
    alone = [
        "Chad Merrow repaired the indexer on Tuesday.", "Thanks to Mali Okafor-Lindt for reviewing the patch.",
        "Version Togo of the client fixes two bugs.", "A guinea Guinea fowl logo was drawn in Oslo.",
    ]
    for r in G.africa_features(texts(spark, *alone, is_official_source=True), default_lexicon(spark)).collect():
        assert not r.countries and r.rejected_ambiguous and r.label in (G.A4, G.A3)
    r = features(spark, "New offices open in West Africa this spring: Senegal first, then Niger and Mali.")
    assert {"Mali", "Niger", "Senegal"} <= set(r.countries) and not r.rejected_ambiguous
    assert "Niger" not in features(spark, "Customers in Nigeria are served from Lagos.").countries


def test_label_ladder(spark):
    a1 = "This spring builders in Kenya and Nigeria may apply for a developer grant, and a hackathon follows."
    assert features(spark, a1, is_official_source=True).label == G.A1
    assert features(spark, "Two hackathons, in Accra and in Lagos, will test payment with MoMo.").label in (G.A1, G.A2)
    a3 = "A design for cross-border remittance and micropayments in any stablecoin."
    assert features(spark, a3, is_official_source=True).label == G.A3
    assert features(spark, "A rollup made for card games and puzzles.", is_official_source=True).label == G.A4
    rumour = "Somebody says they want a country manager for Kenya and Nigeria soon."
    assert features(spark, rumour).label != G.A1 and features(spark, rumour, is_official_source=True).label == G.A1
    team = features(spark, "The ambassador programme in Nigeria is run from Lagos by our team.", is_official_source=True, has_local_team=True)
    assert team.label == G.A5 and team.whitespace == 3.0


def test_absent_evidence_scores_zero(spark):
    r = features(spark, "A rollup made for card games and puzzles.", is_official_source=True)
    assert (r.whitespace, r.contactability, r.operating_capacity, r.total_score, r.label_confidence) == (0, 0, 0, 0, 0)
    r = features(spark, "By the roadmap a community manager starts with us in Nigeria.", is_official_source=True, has_local_team=False, has_public_contact=True, has_funding_or_activity=True)
    assert (r.whitespace, r.contactability, r.operating_capacity) == (15, 10, 10) and r.total_score > 60
    assert features(spark, "The team looks for a community manager.", is_official_source=True).regional_action == 0


def test_stripped_diacritics_and_odd_unicode(spark):
    lex = spark.createDataFrame([("country", "Nigeria", "Nigéria", False), ("country", "Nigeria", "Nigeria", False), ("rail", "m-pesa", "m-pesa", False)], SCHEMA)
    docs = texts(spark, "le Nigéria.", "le NIGERIA!", "le Ｎｉｇｅｒｉａ", "Nigéria", "xNigeria", "M-PESA now", "m‑pesa")
    got = {(r.doc_id, r.entity) for r in G.match_lexicon(docs, lex).collect()}
    assert got >= {(0, "Nigeria"), (1, "Nigeria"), (2, "Nigeria"), (3, "Nigeria"), (5, "m-pesa")} and not any(d == 4 for d, _ in got)


def test_terms_of_several_words(spark):
    docs = texts(spark, "Hiring a country manager in Côte d'Ivoire, Lagos.", "áfrica e Angola: entrada no mercado", "developer  relations in são tomé e príncipe", "nothing")
    got = {(r.doc_id, r.entity) for r in G.match_lexicon(docs, default_lexicon(spark)).collect()}
    assert {(0, "Nigeria"), (1, "Angola")} <= got and not any(d == 3 for d, _ in got)


def test_one_folding_for_any_lexicon_size(spark):
    lex = spark.createDataFrame([("rail", "ramp", "\ufb01at ramp", False)], SCHEMA)
    docs = texts(spark, "the fiat ramp opens")
    assert G.match_lexicon(docs, lex).count() == 1


def test_country_scores(spark):
    f = G.africa_features(texts(spark, "Shops in Nairobi, Kenya can now take M-Pesa; a country manager will work out of Lagos in Nigeria.", is_official_source=True), default_lexicon(spark))
    got = {r.country: r for r in G.country_scores(f, countries_dim(spark)).collect()}
    assert got["Kenya"].iso2 == "KE" and got["Nigeria"].is_priority_market and got["Kenya"].matched_hubs == ["Nairobi"] and got["Kenya"].strength == 1.0


def test_lexicon_from_files(spark, tmp_path):
    docs = {
        "countries": {"countries": [{"name": "Chad", "aliases": ["Tchad"], "demonyms": ["Chadian"], "ambiguous_aliases": ["Chad"]}]},
        "hubs_and_rails": {"priority_hubs": [{"city": "Lagos", "country": "Nigeria"}], "currencies": [{"code": "NGN"}], "payment_rails": ["ussd"]},
        "regions_and_blocs": {"regions": {"West Africa": ["Benin"]}, "economic_blocs": {"AU": {"aliases": ["African Union"]}}},
        "languages": {"languages": {"sw": {"intent_terms": ["balozi"], "geography_terms": ["kenya"]}}},
        "intent_keywords": {"intent_packs": {"hiring": {"terms": ["devrel"]}}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    got = {(r.kind, r.entity, r.term, r.ambiguous) for r in load_lexicon(spark, str(tmp_path)).collect()}
    assert {("country", "Chad", "Chad", True), ("country", "Chad", "Tchad", False), ("hub", "Nigeria", "Lagos", False), ("bloc", "AU", "African Union", False), ("language", "sw", "balozi", False), ("intent", "hiring", "devrel", False)} <= got


# -- funding ---------------------------------------------------------------------------------------


def test_funding_claim(spark):
    text = (
        "Harbour Nine, a payments company, raises $40 million in a seed round led by Quarry Peak Ventures "
        "with participation from Lantern Street Capital. Entry costs $50."
    )
    docs = spark.createDataFrame([(1, text, True)], "doc_id long, text string, is_official boolean")
    (r,) = FU.extract_funding(docs).collect()
    assert (r.round_type, r.amount_usd, r.amount_as_published, r.lead_investor) == ("seed", 40e6, "$40 million", "Quarry Peak Ventures")
    assert "Lantern Street Capital" in r.investors and r.confidence >= 0.85


def test_investor_list(spark):
    docs = spark.createDataFrame([(1, "It raised $5m, joined by One, Two and Three Capital, the round's friends, X and others.")], "doc_id long, text string")
    # A list that ends in "and others" is split before its tail could be cut.
    assert FU.extract_funding(docs).first().investors == ["One", "Two and Three Capital", "others"]


def test_enrichment_is_idempotent(spark):
    cands = spark.createDataFrame([(1, "Zed Galileo Testnet", "zed-galileo-testnet"), (2, "Other", "other")], "candidate_id long, canonical_name string, slug string")
    kb = spark.createDataFrame(
        [(7, ["zed", "zed-galileo-testnet"], "seed", 4e7, "$40 million", "USD", "Quarry Peak Ventures", ["Quarry Peak Ventures"], "https://k", "q", 0.95, T0)],
        "kb_id long, names array<string>, round_type string, amount_usd double, amount_as_published string, currency string, lead_investor string, investors array<string>, source_url string, quote string, confidence double, announced_at timestamp",
    )
    news = spark.createDataFrame([(2, 5, "Other raised $3m in a seed round.", "https://n", T0)], "candidate_id long, doc_id long, text string, source_url string, published_at timestamp")
    ev, rounds = FU.enrich_funding(cands, kb, news, T0)
    ev2, rounds2 = FU.enrich_funding(cands, kb, news, T0 + timedelta(days=1))
    assert rounds.count() == 2 and {r.candidate_id for r in rounds.collect()} == {1, 2}
    key = ["source_id", "external_id"]
    assert ev.count() == 2 and ev2.join(ev.select(*key), key, "left_anti").count() == 0
    both = rounds2.withColumn("seq", F.lit("a")).unionByName(rounds.withColumn("seq", F.lit("b")))
    assert FU.upsert_funding_rounds(both).count() == 2


# -- resolution ------------------------------------------------------------------------------------

OBS = (
    "evidence_id string, observed_at timestamp, candidate_name string, organization_name string, organization_domains array<string>, "
    "github_orgs array<string>, stack_family string, protocol_namespace string, human_chain_id string, genesis_fingerprint string"
)


def resolve(spark, rows):
    obs = spark.createDataFrame([(f"e{i}", T0 + timedelta(days=i), *r) for i, r in enumerate(rows)], OBS)
    return R.resolve_candidates(R.with_network_identity(R.resolve_organizations(obs)))


def test_same_chain_id_two_domains_never_merges(spark):
    df = resolve(spark, [("Kora", None, ["kora.io"], [], "evm", None, "77", None), ("Zeta", None, ["zeta.io"], [], "evm", None, "0x4d", None)] * 3)
    assert df.select("candidate_id").distinct().count() == 2
    claims = df.select("caip2", F.col("org_id").alias("organization_id"), "candidate_id", "observed_at")
    (task,) = R.caip2_collisions(claims).collect()
    first = {r.candidate_name: r.candidate_id for r in df.collect()}
    assert (task.caip2, task.candidate_id, task.related_candidate_id) == ("eip155:77", first["Kora"], first["Zeta"])


def test_name_never_links_and_shared_github_does(spark):
    df = resolve(spark, [("Acme", None, ["a.io"], ["acme"], "evm", None, None, None), ("Acme", None, ["b.io"], [], "evm", None, None, None), ("Acme Two", None, [], ["acme"], "evm", None, None, None)])
    org = {r.evidence_id: r.org_id for r in df.collect()}
    assert org["e0"] == org["e2"] != org["e1"]
    cands = df.groupBy("candidate_id").agg(F.min("org_id").alias("organization_id"), F.min("candidate_name").alias("canonical_name"), F.min("observed_at").alias("first_seen_at"), F.array(F.min("candidate_name")).alias("aliases"))
    assert R.weak_name_matches(cands).count() == 1


def test_order_does_not_matter(spark):
    rows = [(f"N{i % 4}", None, [f"d{i % 7}.io"], [f"g{i % 5}"] if i % 3 == 0 else [], "evm", None, str(i % 6), None) for i in range(30)]
    obs = [(f"e{i}", T0 + timedelta(days=i), *r) for i, r in enumerate(rows)]
    a = R.resolve_organizations(spark.createDataFrame(obs, OBS)).select("evidence_id", "org_id").collect()
    b = R.resolve_organizations(spark.createDataFrame(obs[::-1], OBS)).select("evidence_id", "org_id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_genesis_links_across_organisations_and_supersedes(spark):
    df = resolve(spark, [("K", None, ["k.io"], [], "evm", None, "9", "0xa"), ("K2", None, ["l.io"], [], "evm", None, "9", "0xa"), ("K", None, ["k.io"], [], "evm", None, "9", "0xb"), ("M", None, ["m.io"], [], "evm", None, "3", None)])
    ids = {r.evidence_id: r.candidate_id for r in df.collect()}
    assert ids["e0"] == ids["e1"] == ids["e2"] != ids["e3"]
    inc = {r.genesis_fingerprint: r for r in R.incarnations(df.withColumn("network_id", F.col("caip2"))).collect()}
    assert inc["0xa"].status == "superseded" and inc["0xa"].superseded_by_id == inc["0xb"].incarnation_id and inc["0xb"].status == "active" and len(inc) == 2


# -- scoring ---------------------------------------------------------------------------------------

EV = "candidate_id string, source_id string, source_family string, observed_at timestamp"


def scored(spark, as_of=T0, days=(1, 2), families=("registry", "code_search"), **facts):
    ev = spark.createDataFrame([("c", f"s{i}", f, as_of - timedelta(days=d)) for i, (d, f) in enumerate(zip(days, families))], EV)
    base = {"stage": S.S2, "has_domain": True, "has_repo": True, "has_fingerprint": True, "verified_genesis": True, "has_testnet": True, "label": "A1_explicit_intent", "fit": 85.0, "risk": 10.0, **facts}
    c = spark.createDataFrame([("c",)], "candidate_id string")
    for k, v in base.items():
        c = c.withColumn(k, F.lit(v))
    return S.score_candidates(c, ev, as_of).first()


def test_strong_candidate_is_hot(spark):
    r = scored(spark)
    assert r.c_attribution == 20 and r.c_technical == 20 and r.confidence >= 65 and r.momentum >= 40 and r.state == "HOT"


def test_gate_staleness_and_blocks(spark):
    assert scored(spark, verified_genesis=False).c_technical == 15
    r = scored(spark, has_domain=False, has_repo=False)
    assert not r.gate_passed and "no official attribution" in r.gate_failures
    assert scored(spark, days=(40, 41)).state == "STALE"
    assert scored(spark, hard_blocked=True).state == "REJECT"
    assert scored(spark, stage=S.S0, label="A3_africa_compatible").state != "HOT"


def test_freshness_half_lives(spark):
    ev = spark.createDataFrame([("c", "s", "social", T0 - timedelta(days=7)), ("c", "r", "registry", T0 - timedelta(days=7)), ("c", "x", "social", T0 + timedelta(days=1))], EV)
    got = {r.source_family: r.freshness for r in S.family_freshness(ev, T0).collect()}
    assert got["social"] < 2.5 and got["registry"] > 7.0


def test_vitality_rules(spark):
    act = "candidate_id string, channel string, observed_at timestamp, snapshot_id int, last_activity_at timestamp"
    rows = [("a", "github", T0, 1, T0 - timedelta(days=200)), ("b", "x", T0, 2, None), ("c", "github", T0, 3, T0 - timedelta(days=10))]
    live = spark.createDataFrame([("a", True)], "candidate_id string, live boolean")
    got = {r.candidate_id: r for r in A.assess_vitality(spark.createDataFrame(rows, act), T0, live).collect()}
    assert got["a"].vitality == "slowing" and got["a"].vitality_score == 60 and got["b"].vitality == "unknown" and got["c"].vitality == "active"
    assert "rpc" in got["c"].unobserved_channels


# -- verification, normalisation, exports ------------------------------------------------------------


def test_liveness_fails_closed(spark):
    schema = "endpoint_hash string, probe_id int, candidate_id string, observed_at timestamp, success boolean, block_height long, identity_fingerprint string, failure_class string"
    rows = []
    for i, (h1, h2, f1, f2) in enumerate([(1, 2, "f", "f"), (2, 2, "f", "f"), (1, 2, None, "f"), (1, 2, "f", "g")]):
        rows += [(f"e{i}", 1, "c", T0, True, h1, f1, None), (f"e{i}", 2, "c", T0 + timedelta(seconds=90), True, h2, f2, None)]
    rows.append(("e9", 1, "c", T0, True, 1, "f", None))
    got = {r.endpoint_hash: r for r in V.liveness(spark.createDataFrame(rows, schema)).collect()}
    assert [got[f"e{i}"].live for i in range(4)] == [True, False, False, False] and got["e1"].failure_class == "non_advancing"
    assert not got["e9"].live and got["e9"].failure_class is None and got["e0"].gap_seconds == 90


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("https://8.8.8.8:8545/x", None), ("http://a.io", "scheme"), ("https://127.0.0.1", "address"), ("https://[::1]/", "address"), ("https://a.io:22", "port"),
        ("https://[::ffff:10.0.0.1]/", "address"), ("https://[2606:4700::1111]/", None), ("", "empty"), ("ftp://a", "scheme"), ("https:///x", "host"), ("https://169.254.169.254/", "address"),
    ],
)
def test_endpoint_policy(spark, url, reason):
    assert V.screen_endpoints(spark.createDataFrame([(url,)], "url string")).first().rejected_for == reason


def raw(spark, source, payload):
    return spark.createDataFrame([(source, "1", T0, json.dumps(payload))], "source_id string, external_id string, observed_at timestamp, payload string")


def test_normalisers(spark):
    r = N.normalize_evm_chain_json(raw(spark, "ethereum_lists", {"chainId": 1001, "name": "Brindle Mainnet", "rpc": ["https://rpc.brindle.example", "wss://x"], "infoURL": "https://brindle.example", "status": "active"})).first()
    assert (r.candidate_name, r.caip2, r.environment, r.organization_domains, r.rpc_urls) == ("Brindle Mainnet", "eip155:1001", "mainnet", ["brindle.example"], ["https://rpc.brindle.example"])
    r = N.normalize_cosmos_chain_json(raw(spark, "cosmos_chain_registry", {"chain_name": "tidepool", "pretty_name": "Tidepool", "chain_id": "tidepool-1", "network_type": "mainnet"})).first()
    assert (r.candidate_name, r.caip2, r.stack_family) == ("Tidepool", "cosmos:tidepool-1", "cosmos")
    job = {"org_name": "Sable Trust", "title": "Community Lead, Africa", "location": "Lagos, Nigeria", "url": "https://jobs/1"}
    r = N.normalize_job_postings(raw(spark, "ats_job_boards", job), default_lexicon(spark), countries_dim(spark)).first()
    assert r.opportunities[0].signal_strength == 1.0 and "Nigeria" in r.opportunities[0].geography and r.contacts[0].channel_value == "https://jobs/1"
    pr = {"pr_number": 7, "title": "Add Sable Chain testnet (chainId: 987)", "body": "see https://a.rpc.sable.example", "created_at": "2026-01-02T00:00:00Z", "user": "u"}
    r = N.normalize_registry_prs(raw(spark, "ethereum_lists", pr)).first()
    assert (r.candidate_name, r.caip2, r.stage, r.claims["registry_pr_opened_at"]) == ("Sable Chain testnet", "eip155:987", S.S2, "2026-01-02T00:00:00Z")


def test_landing_append_and_export(spark, tmp_path):
    lines = [{"source_id": "s", "external_id": str(i), "observed_at": f"2026-01-0{i + 1}T00:00:00Z", "payload": "{}"} for i in range(3)]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    df = TB.read_raw_items(spark, str(tmp_path / "in.json"))
    assert [r.source_id for r in df.collect() if r["_corrupt_record"] is not None] == [None]
    good = df.filter("source_id IS NOT NULL").drop("_corrupt_record")
    for _ in range(2):
        TB.append_table(good, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 6 and back.select("observed_date").distinct().count() == 3
    rows = spark.range(3).selectExpr("id", *[f"'x' AS {c}" for c in TB.JSON_COLUMNS if c != "id"])
    TB.export_candidates(rows, str(tmp_path / "csv"))
    TB.export_candidates(rows, str(tmp_path / "json"), "json")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns[0] == "id" and spark.read.json(str(tmp_path / "json")).count() == 3


def test_stream_ledger_is_idempotent(spark, tmp_path):
    from winnow.streaming.ingest import run_ledger, stream_raw_items

    src = tmp_path / "in"
    src.mkdir()
    item = {"source_id": "s", "external_id": "1", "content_hash": "h", "observed_at": "2026-01-01T00:00:00Z", "url": "https://a.io/?token=x"}
    for n in range(3):
        (src / f"{n}.json").write_text(json.dumps(item) + "\n" + json.dumps({**item, "external_id": f"n{n}", "content_hash": f"k{n}"}))
        run_ledger(stream_raw_items(spark, str(src), files_per_trigger=1), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "ledger")).collect()
    assert sorted(r.external_id for r in rows) == ["1", "n0", "n1", "n2"] and all("<redacted>" in r.url for r in rows)


# -- backtest --------------------------------------------------------------------------------------


def test_backtest_targets(spark):
    ev_p = [("registry", 0), ("official_web", 2), ("code_search", 5), ("careers", 9)]
    rows = []
    for i in range(1, 51):
        even = i % 2 == 0
        text = f"Net {i} invites builders in Lagos, Nigeria to its testnet; developer grants open the Africa expansion." if even else f"Net {i} moves remittance volume in a stablecoin on its beta main network."
        rows.append((f"P{i}", i, True, datetime(2026, 1, i % 28 + 1), datetime(2026, 6, i % 28 + 1), text, "A1_explicit_intent" if even else "A3_africa_compatible", True, True, True, S.S2 if even else S.S4, str(70000 + i), False, ev_p))
    for i in range(1, 151):
        rows.append((f"M{i}", 100 + i, False, datetime(2026, 2, i % 28 + 1), None, "cheap presale tokens at 0xfeed today.", None, False, False, False, S.S0, None, True, [("social", 0), ("market", 1)]))
    corpus = spark.createDataFrame(
        rows,
        "name string, ordinal int, is_positive boolean, first_eligible_signal timestamp, mainnet_live_at timestamp, sample_text string, expected_label string, "
        "verified_genesis boolean, has_domain boolean, has_repo boolean, stage string, chain_id string, is_token_only boolean, events array<struct<family:string,day_offset:int>>",
    )
    lex = default_lexicon(spark)
    cut = spark.createDataFrame([(datetime(2026, 2, 10),)], "cutoff timestamp")
    ab = spark.createDataFrame([("",), ("registry",), ("careers",), ("social",)], "ablation string")
    res = B.replay(corpus, lex, cut, ab).cache()
    m = B.backtest_metrics(res.filter("ablation = ''")).first()
    assert m.detected_positives == 50 and m.precision_at_20 >= 0.8 and m.label_precision >= 0.9 and m.false_promotions == 0
    assert B.source_ablation(res).filter("unique_contributor").count() >= 1
    cuts = spark.sql("SELECT explode(sequence(timestamp'2026-01-01', timestamp'2026-03-15', interval 2 days)) AS cutoff")
    s = B.cutoff_sweep(B.replay(corpus, lex, cuts), corpus).first()
    assert s.positive_recall >= 0.8 and s.false_promotion_rate == 0 and s.median_time_to_discovery_days <= 7 and s.median_lead_days > 30


# -- regressions -----------------------------------------------------------------------------------


def test_channel_hash_is_trim_and_casefold(spark):
    import hashlib

    from winnow.functions.text import canonical_json_hash, channel_hash

    values = ["Ann@X.de ", "\u2003Straße@x.de", "ΣΟΦΟΣ@x.gr", "İ@x", "Ａ@x", "", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    for r in df.select("v", channel_hash(df.v).alias("h")).collect():
        assert r.h == hashlib.sha256((r.v or "").strip().casefold().encode()).hexdigest(), r.v
    got = [r[0] for r in spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2, "b":1}',), ("{broken",), (None,)], "p string").select(canonical_json_hash(F.col("p"))).collect()]
    assert got[0] == got[1] and got[2] == hashlib.sha256(b"{broken").hexdigest() and got[3] is None


def test_visible_events_keeps_all_cutoffs_and_ablations(spark):
    from winnow.operators.resolve import visible_events

    ev = spark.createDataFrame([(1, datetime(2026, 1, 1, 12), "a"), (2, datetime(2026, 1, 3), "b")], "id int, observed_at timestamp, source_family string")
    cuts = spark.range(6000).selectExpr("timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS cutoff")
    ab = spark.range(6000).selectExpr("IF(id = 0, '', 'f' || id) AS ablation", "'f' || id AS source_family")
    assert visible_events(ev, cuts).count() == (6000 - 720) + (6000 - 2880) and visible_events(ev.limit(1), cuts.limit(5), ab).count() == 0
    one = spark.createDataFrame([(datetime(2026, 1, 5),)], "cutoff timestamp")
    assert visible_events(ev, one, ab).count() == 2 * 6000


def test_ledger_ends_on_missing_keys(spark):
    from winnow.operators import ledger as L

    rows = [("s", None, "h", T0), (None, "1", "h", T0), ("s", "2", None, T0), ("s", "3", "h", T0), ("s", "3", "k", T0), ("t", "4", "k", T0)]
    df = spark.createDataFrame(rows, "source_id string, external_id string, content_hash string, observed_at timestamp")
    assert sorted((r.source_id, r.external_id, r.content_hash) for r in L.append_evidence(df).collect()) == [("s", "3", "h"), ("t", "4", "k")]
    assert L.keyless_items(df).count() == 3


def test_knowledge_base_matches_are_containment(spark):
    c = spark.createDataFrame([(1, "Chainworks", "chainworks"), (2, "Chain", "chain"), (3, "abc", "abc"), (4, "The Longchain Net", "x")], "candidate_id long, canonical_name string, slug string")
    k = spark.createDataFrame([(10, ["chain"]), (11, ["chainworks labs", "abc"]), (12, ["longchain"]), (13, ["works"])], "kb_id long, names array<string>")
    got = {(r.candidate_id, r.kb_id) for r in FU.match_funding_kb(c, k).collect()}
    assert got == {(1, 10), (2, 10), (4, 10), (1, 11), (2, 11), (3, 11), (4, 12), (2, 12), (1, 13)}


def test_swept_features_equal_features_of_visible_events(spark):
    """The sweep against the product of events, cutoffs and ablations."""
    import random

    from winnow.operators.resolve import visible_events
    from winnow.operators.score import evidence_features

    rnd = random.Random(8)
    fams = ["registry", "social", "careers", "official_web", "market", "unknown", None]
    ev = [(f"c{rnd.randrange(6)}", f"s{rnd.randrange(5)}", rnd.choice(fams), T0 + timedelta(days=rnd.randrange(60), hours=rnd.choice([0, 0, 7]))) for _ in range(300)]
    ev = spark.createDataFrame(ev, "candidate_id string, source_id string, source_family string, observed_at timestamp")
    cuts = spark.createDataFrame([(T0 + timedelta(days=d),) for d in (-3, 0, 5, 14, 19, 33, 90)] * 2, "cutoff timestamp")
    ab = spark.createDataFrame([("",), ("social",), ("registry",), ("none",)], "ablation string")
    keys = ["candidate_id", "cutoff", "ablation"]
    seen = visible_events(ev, cuts, ab)
    want = evidence_features(seen, F.col("cutoff"), keys=tuple(keys))
    cols = [*keys, "latest_evidence_at", "first_evidence_at", "evidence_count", "recent_count", "recent_sources", "recent_commercial", "n_families", "has_registry_evidence", F.round("freshness", 9).alias("freshness")]
    got = sorted(map(str, B.swept_features(ev, cuts, ab).select(*cols).collect()))
    assert got == sorted(map(str, want.select(*cols).collect())) and len(got) > 60
    assert B.swept_features(ev, cuts).count() == want.filter("ablation = ''").count()
    assert B.swept_features(ev.limit(0), cuts, ab).count() == 0 == B.swept_features(ev, cuts.limit(0)).count()


def test_resolution_in_batches_equals_one_run(spark):
    """Three batches on stored components, with the key changes they report, give what one run gives."""
    import random

    rnd = random.Random(12)
    rows = [(f"e{i:03d}", T0 + timedelta(hours=rnd.randrange(400)), f"N{rnd.randrange(30)}", None, [f"d{rnd.randrange(25)}.io"] if i % 4 else [], [f"g{rnd.randrange(20)}"] if i % 3 == 0 else [], "evm", None, None, None) for i in range(120)]
    whole = {r.evidence_id: r.org_id for r in R.resolve_organizations(spark.createDataFrame(rows, OBS)).collect()}
    rnd.shuffle(rows)
    old, keys = None, {}
    for part in (rows[:50], rows[50:90], rows[90:]):
        out = R.organization_batch(spark.createDataFrame(part, OBS), old)
        changed = {r.old_key: r.new_key for r in out.changed.collect()}
        keys = {e: changed.get(k, k) for e, k in keys.items()} | {r.evidence_id: r.org_id for r in out.resolved.collect()}
        touched = out.labels.count()
        old = out.applied_to(old)
        assert old.labels.count() == old.labels.select("node").distinct().count() and old.heads.count() == old.labels.select("component").distinct().count()
    assert keys == whole and touched < old.labels.count()


def test_observations_without_identifiers_stay(spark):
    obs = [("e0", T0, None, None, None, None, "evm", None, None, None), ("e1", T0, None, None, [], [], None, None, None, None), ("e2", T0, "K", None, ["k.io"], [], "evm", None, "9", None)]
    df = R.resolve_organizations(spark.createDataFrame(obs, OBS))
    ids = {r.evidence_id: r.org_id for r in df.collect()}
    assert len(ids) == 3 and all(ids.values())
    odd = R.with_network_identity(df).withColumn("org_id", F.when(F.col("evidence_id") == "e2", F.col("org_id"))).withColumn("slug", F.lit(None).cast("string"))
    got = {r.evidence_id: r.candidate_id for r in R.resolve_candidates(odd).collect()}
    assert len(got) == 3 and all(got.values())


def test_automaton_equals_join_on_words(spark):
    """Small lexicons take the automaton, large ones the join; both find the same."""
    import random

    rnd = random.Random(2)
    lex = default_lexicon(spark).unionByName(spark.createDataFrame([("rail", "r", "$x-pay", False), ("rail", "q", "naïve  Pay", False), ("pan", "p", "áfrica ", False), ("hub", "h", "—", False)], SCHEMA))
    terms = [r.term for r in lex.collect()]
    glue = [" ", "  ", "-", "_", "x", ". ", "’", "́ ", " ", ""]
    made = ["".join(rnd.choice([t, t.upper(), t.replace("e", "é")]) + rnd.choice(glue) for t in rnd.sample(terms, 6)) for _ in range(150)] + [None, ""]
    docs = texts(spark, *made)
    cols = ["doc_id", "kind", "entity", "term", "ambiguous"]
    a = sorted(map(tuple, G.match_lexicon(docs, lex).select(*cols).collect()))
    b = sorted(map(tuple, G.match_lexicon(docs, lex, max_terms=3).select(*cols).collect()))
    assert a == b and len(a) > 300
    assert G.match_lexicon(docs, lex.limit(0)).count() == 0
    plan = G.match_lexicon(docs, lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_places_match_the_texts_once(spark):
    """Four kinds of places come from one pass over the texts; a kind without values hides no other."""
    f = G.africa_features(texts(spark, "Payments by M-Pesa in Nairobi, Kenya, for ECOWAS and West Africa.", "nothing"), default_lexicon(spark))
    f = f.withColumn("candidate_id", F.col("doc_id")).withColumn("languages", F.lit(None).cast("array<string>"))
    places = A.assessment_places(f)
    got = {(r.candidate_id, r.kind, r.name) for r in places.collect()}
    assert {(0, "country", "Kenya"), (0, "region", "ECOWAS"), (0, "region", "West Africa")} <= got
    assert {k for _, k, _ in got} == {"country", "region", "rail"} and {c for c, _, _ in got} == {0}
    assert places._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_spaces_are_not_replaced_by_themselves():
    """Each run of white space becomes one space, as by a pattern of all of them, which took 20 times as long on the documents."""
    import random
    import re
    import time

    from winnow.functions.automaton import folded

    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    pattern, r = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), random.Random(3)
    for _ in range(5_000):
        text = "".join(r.choice(spaces + "ab\x1c\u200b") for _ in range(r.randint(0, 12)))
        assert folded(text + "ß", "native")[0] == pattern.sub(" ", text + "ss")
    text = "plain words of a long text " * 200_000

    def seconds(f) -> float:
        start = time.process_time()
        f()
        return time.process_time() - start

    assert min(seconds(lambda: folded(text, "full")) for _ in range(3)) < 0.5 * min(seconds(lambda: pattern.sub(" ", text.lower())) for _ in range(3))


def test_snippets_shuffle_texts_once(spark):
    """Texts are folded after they met their needles; before, both forms of every text went to the join."""
    rows = [(0, "Kenya desk\nnothing\n KENYA again "), (1, "no places"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = G.snippets(docs, G.extract_geography(docs, default_lexicon(spark)))
    assert {x.doc_id: x.snippets for x in out.collect()} == {0: ["Kenya desk", "KENYA again"]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(text" in plan[: plan.index("Join Inner")] and "lower(text" not in plan[plan.index("Join Inner") :]


def test_marks_cost_no_more_than_the_text():
    """Marks are found among the text's own characters; a pattern of all marks took about a microsecond for each character (16 seconds here)."""
    import sys
    import time
    import unicodedata

    from winnow.functions.automaton import folded

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for i in range(0, len(every), 50_000):
        part = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", every[i : i + 50_000]).casefold())
        bare = "".join(c for c in part if unicodedata.category(c) != "Mn")
        assert folded("é" + every[i : i + 50_000], "full")[1].split() == ("e" + bare).split() or "\u200b" in bare or "\x1c" in bare
    text = "é plain words of a long text " * 200_000
    start = time.process_time()
    assert folded(text, "full")[1].startswith("e plain")
    assert time.process_time() - start < 5


def test_sentences_are_read_once_for_amounts(spark):
    """Five passes of one pattern over each sentence before; the parts of an amount are the same in its own text."""
    made = ["It raised $1,234.5 mm today.", "They raised USD 5 millions.", "A round of €3.5bn closed a seed, 12 k", "raised £ 700", "Announced a funding of JPY 2,000 b.", "SERIES  B raised"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    claims = FU.extract_funding(docs)
    got = {r.doc_id: (r.round_type, r.amount_as_published, r.amount_usd, r.currency) for r in claims.collect()}
    assert got == {
        0: ("undisclosed", "$1,234.5 mm", 1234.5e6, "USD"), 2: ("seed", "€3.5bn", None, "EUR"), 4: ("undisclosed", "JPY 2,000 b", None, "JPY"), 5: ("series_b", None, None, "USD"),
    }
    assert claims._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_candidates_of_one_name_meet_announcements_once(spark, monkeypatch):
    """Candidates times announcements of one name grow with the square; their records do not."""
    cands = spark.createDataFrame([(i, "Zed Galileo", "zed") for i in range(40, 80)] + [(1, None, "solo")], "candidate_id long, canonical_name string, slug string")
    row = lambda i, name: (i, [name], "seed", 4e7, "$40 million", "USD", f"Lead {i}", [f"Lead {i}"], "https://k", "q", 0.95, T0)
    kb = spark.createDataFrame(
        [row(i, "zed") for i in range(30)] + [row(99, "solo")],
        "kb_id long, names array<string>, round_type string, amount_usd double, amount_as_published string, currency string, lead_investor string, investors array<string>, source_url string, quote string, confidence double, announced_at timestamp",
    )
    news = spark.createDataFrame([(41, 5, "Zed raised $3m in a seed round.", "https://n", T0)], "candidate_id long, doc_id long, text string, source_url string, published_at timestamp")
    met, match = [], FU.match_funding_kb
    monkeypatch.setattr(FU, "match_funding_kb", lambda c, k: met.append(c.count()) or match(c, k))
    ev, rounds = FU.enrich_funding(cands, kb, news, T0)
    got = rounds.collect()
    assert sorted(r.candidate_id for r in got) == [1, *range(40, 80)] and len({r.lead_investor for r in got if r.candidate_id > 1}) == 1
    assert ev.count() == 31 and {r.candidate_id for r in ev.collect()} == {1, 40} and met == [2]


def test_aliases_read_the_observations_once(spark):
    """Three branches over the observations before; labels that are null hide no name."""
    at = lambda d: T0 + timedelta(days=d)
    rows = [("c1", "b", at(1), "Zed  Labs", ["l2"]), ("c1", "a", at(0), "Harbour Chain", None), ("c1", "c", at(2), "Harbour Chain", ["l2", None, ""]), ("c2", "d", at(0), None, ["zk"])]
    obs = spark.createDataFrame(rows, "candidate_id string, evidence_id string, observed_at timestamp, candidate_name string, purpose_labels array<string>")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    out = R.candidate_aliases(obs.withColumn("candidate_name", counted.asNondeterministic()("candidate_name")))
    got = {tuple(r) for r in out.collect()}
    names = {"Zed  Labs", "zed labs", "Harbour Chain", "harbour chain", "harbour"}
    assert got == {("c1", "alias", n) for n in names} | {("c1", "purpose", "l2"), ("c2", "purpose", "zk")}
    assert seen.value == len(rows)


def test_names_and_hosts_are_worked_out_once(spark):
    """Generators share no common expressions: what an expression names twice is computed twice."""
    from winnow.functions import text as X

    rows = [("Zed  Labs!",), (" -- ",), ("",), (None,), ("https://www.A.example/x",), ("u:p@B.example:80",), ("https://",), ("0",), ("+007",), ("-0",), ("0x1F",), ("12",), ("012",)]
    df = spark.createDataFrame(rows, "v string").select("v", X.slug(F.col("v"), "native").alias("s"), X.domain(F.col("v")).alias("d"), X.chain_id(F.col("v")).alias("c"))
    got = {r.v: (r.s, r.d, r.c) for r in df.collect()}
    assert got["Zed  Labs!"][0] == "zed-labs" and got[" -- "][0] == got[""][0] == got[None][0] == "unknown"
    assert (got["https://www.A.example/x"][1], got["u:p@B.example:80"][1], got["https://"][1], got[""][1], got[None][1]) == ("a.example", "b.example", None, None, None)
    assert [got[v][2] for v in ("0", "+007", "-0", "0x1F", "12", "012")] == ["0", "7", "0", "31", "12", "12"] and got[None][2] is None
    plan = lambda c: df.select("v").select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(X.slug(F.col("v"), "native")).count("regexp_replace(") == 4 and plan(X.domain(F.col("v"))).count("regexp_extract(") == 1


def test_keys_are_hashed_once_for_a_set(spark):
    """Observations of one set of identifiers share their key; it was hashed for every row before."""
    obs = spark.range(100).select(
        F.lit("o").alias("org_id"), F.col("id").cast("string").alias("evidence_id"), F.timestamp_seconds("id").alias("observed_at"),
        F.lit("net").alias("slug"), F.lit(None).cast("string").alias("caip2"), F.lit(None).cast("string").alias("genesis_fingerprint"),
    )
    seen, plain = [], R.stable_key
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "stable_key", lambda *c: seen.append(c) or plain(*c))
        out = R.resolve_candidates(obs).select("candidate_id").distinct().collect()
    want = spark.range(1).select(plain(F.lit(" O"), F.lit("NET"))).first()[0]
    assert [r.candidate_id for r in out] == [want] and ["first" in str(c[0]) for c in seen] == [True]


def test_attributes_read_the_observations_once(spark):
    """Sets of attributes come from one pass, and raw values are told apart before they are cut to domains."""
    rows = [("o", "a", T0, ["https://www.A.example/x", "a.example", None], [" g ", ""], None), ("o", "b", T0, None, ["g"], ["Kenya"])]
    obs = spark.createDataFrame(rows, "org_id string, evidence_id string, observed_at timestamp, organization_domains array<string>, github_orgs array<string>, claimed_locations array<string>")
    out = R.merge_org_attrs(obs)
    assert sorted(map(tuple, out.collect())) == [("o", "domain", "a.example"), ("o", "github", "g"), ("o", "location", "Kenya")]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
