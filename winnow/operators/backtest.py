"""Temporal backtest: fixtures × cutoffs × ablations replayed through the live scorer in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from winnow.functions.ordered import MIDDLE, top_n, values_at_ranks, with_next_mark
from winnow.functions.timefn import age_days, epoch
from winnow.operators.geography import ACTIVE_FAMILIES, OFFICIAL_FAMILIES, extract_geography, feature_columns
from winnow.operators.resolve import numbered_cutoffs
from winnow.operators.score import NOT_INDEPENDENT, S4, lookup, score_columns
from winnow.session import cut_lineage
from winnow.settings import DEFAULT, Rules

PROMOTED = ("HOT", "QUALIFIED")
PRECISION_AT = 20


def fixture_events(corpus: DataFrame) -> DataFrame:
    """Evidence rows of each fixture: signal date plus a day offset per family (B1)."""
    return corpus.select("name", "first_eligible_signal", F.explode("events").alias("e")).select(
        F.col("name").alias("candidate_id"),
        F.concat(F.col("e.family"), F.lit("_source")).alias("source_id"),
        F.col("e.family").alias("source_family"),
        (F.col("first_eligible_signal") + F.expr("interval 1 day") * F.col("e.day_offset")).alias("observed_at"),
    )


def family_partials(events: DataFrame, cutoffs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(candidate_id, cutoff, families): what each family's events up to a cutoff amount to.

    Each event changes the running values of its source at two cutoffs: the first that sees it, and the first to which it is no longer
    recent. Values are then carried on from cutoff to cutoff. ``families`` has one entry per family of the candidate.
    """
    numbered = numbered_cutoffs(cutoffs)
    marks = numbered.select("cutoff")
    key = ["candidate_id", "source_id", "source_family"]
    once = events.groupBy(*key, "observed_at").agg(F.count("*").alias("n"))
    moved = once.select("*", F.col("observed_at").alias("_t"), F.lit(False).alias("_late")).unionByName(
        once.select("*", (F.col("observed_at") + F.make_dt_interval(days=F.lit(rules.momentum_days))).alias("_t"), F.lit(True).alias("_late"))
    )
    at = with_next_mark(moved, marks, key).filter(F.col("_mark").isNotNull())
    comes = ~F.col("_late")
    steps = at.groupBy(*key, F.col("_mark").alias("cutoff")).agg(
        F.sum(F.when(comes, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(comes, F.col("n")).otherwise(-F.col("n"))).alias("recent"),
        F.min(F.when(comes, F.col("observed_at"))).alias("first_at"), F.max(F.when(comes, F.col("observed_at"))).alias("last_at"),
    )
    w = W.partitionBy(*key).orderBy("k")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.join(numbered, "cutoff").drop("cutoff")
    runs = steps.select(
        *key, F.sum("n").over(upto).alias("n"), F.sum("recent").over(upto).alias("recent"), F.min("first_at").over(upto).alias("first_at"),
        F.max("last_at").over(upto).alias("last_at"), "k", F.coalesce(F.lead("k").over(w) - 1, F.col("last_k")).alias("_until"),
    )
    runs = runs.withColumn("k", F.explode(F.sequence("k", "_until"))).drop("_until")
    live = F.col("recent") > 0
    # A source counts as live without a family if another family keeps it so.
    named = live & F.col("source_family").isNotNull()
    same = W.partitionBy("candidate_id", "source_id", "k")
    runs = runs.withColumn("_any", F.count(F.when(live, 1)).over(same)).withColumn("_named", F.count(F.when(named, 1)).over(same))
    per_family = runs.groupBy("candidate_id", "k", "source_family").agg(
        F.sum("n").alias("n"), F.sum("recent").alias("recent"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.count_if(named & (F.col("_named") == 1)).alias("own_sources"),
        F.sum(F.when(named & (F.col("_named") > 1), 1 / F.col("_named")).otherwise(0.0)).alias("shared_sources"),
        F.sum(F.when(live, 1 / F.col("_any")).otherwise(0.0)).alias("all_sources"),
    )
    grouped = per_family.groupBy("candidate_id", "k").agg(
        F.collect_list(F.struct("source_family", "n", "recent", "first_at", "last_at", "own_sources")).alias("families"),
        *[F.round(F.sum(c)).cast("bigint").alias(c) for c in ("shared_sources", "all_sources")],
    )
    return grouped.join(numbered, "k").drop("k", "last_k")


def swept_features(events: DataFrame, cutoffs: DataFrame, ablations: DataFrame | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """``evidence_features`` and the evidence flags per candidate and cutoff, and per ablation if asked for.

    An ablation leaves one family, and events without one, out of the combination of ``family_partials``, so its cost is a row of the result.
    """
    rows = family_partials(events, cutoffs, rules)
    keys = ["candidate_id", "cutoff"]
    if ablations is not None:
        names = [r[0] for r in ablations.select("ablation").distinct().orderBy("ablation").collect()]
        rows = rows.withColumn("ablation", F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")))
        kept = F.filter("families", lambda f: (F.col("ablation") == "") | (f["source_family"] != F.col("ablation")))
        rows = rows.withColumn("families", kept)
        keys.append("ablation")
    half = dict(rules.half_life_days)
    named = {k: v for k, v in half.items() if k != "default"}

    def fresh(f: Column) -> Column:
        age = F.greatest(age_days(f["last_at"], F.col("cutoff")), F.lit(0.0))
        return F.lit(10.0) * F.pow(F.lit(0.5), age / lookup(named, f["source_family"], half["default"]))

    def total(field: str) -> Column:
        return F.aggregate("families", F.lit(0).cast("bigint"), lambda acc, f: acc + f[field])

    def some(test) -> Column:
        return F.coalesce(F.exists("families", lambda f: F.coalesce(test(f), F.lit(False))), F.lit(False))

    fam = lambda f: f["source_family"]
    sources = F.col("all_sources")
    if ablations is not None:
        sources = F.when(F.col("ablation") == "", sources).otherwise(total("own_sources") + F.col("shared_sources"))
    active = [f for f in ACTIVE_FAMILIES if f != "infrastructure"]
    return rows.filter(F.size("families") > 0).select(
        *keys,
        F.array_max(F.transform("families", lambda f: f["last_at"])).alias("latest_evidence_at"),
        F.array_min(F.transform("families", lambda f: f["first_at"])).alias("first_evidence_at"),
        total("n").alias("evidence_count"), total("recent").alias("recent_count"), sources.alias("recent_sources"),
        some(lambda f: (f["recent"] > 0) & fam(f).isin("careers", "social")).alias("recent_commercial"),
        F.size(F.filter("families", lambda f: fam(f).isNotNull() & ~fam(f).isin(*NOT_INDEPENDENT))).cast("bigint").alias("n_families"),
        some(lambda f: fam(f) == "registry").alias("has_registry_evidence"),
        F.array_max(F.transform("families", fresh)).alias("freshness"),
        some(lambda f: fam(f).isin(*OFFICIAL_FAMILIES)).alias("is_official_source"),
        F.when(some(lambda f: fam(f).isin(*active)), True).alias("has_funding_or_activity"),
    )


def replay(
    corpus: DataFrame, lexicon: DataFrame, cutoffs: DataFrame, ablations: DataFrame | None = None, rules: Rules = DEFAULT, unicode: str = "full"
) -> DataFrame:
    """Every fixture as of every cutoff, per ablation (B2).

    Fixtures without visible evidence drop out. Text is read once per fixture; only the flags that
    depend on the visible evidence vary by cutoff.
    """
    keys = ["candidate_id", "cutoff"] + (["ablation"] if ablations is not None else [])
    feats = swept_features(fixture_events(corpus), cutoffs, ablations, rules)
    geo = extract_geography(corpus.select(F.col("name").alias("doc_id"), F.col("sample_text").alias("text")), lexicon, unicode).withColumnRenamed("doc_id", "candidate_id")
    chained = F.col("chain_id").isNotNull()
    verified = F.coalesce("verified_genesis", F.lit(False)) & chained
    facts = corpus.select(
        F.col("name").alias("candidate_id"), "ordinal", "is_positive", "expected_label", "mainnet_live_at", "first_eligible_signal", "stage",
        F.col("has_domain"), F.col("has_repo"), F.when(F.col("has_domain"), True).alias("has_public_contact"), F.lit(None).cast("boolean").alias("has_local_team"),
        verified.alias("verified_genesis"), verified.alias("has_fingerprint"), verified.alias("advancing_liveness"), chained.alias("has_rpc"), chained.alias("has_testnet"),
        (F.coalesce("is_token_only", F.lit(False)) & ~chained).alias("hard_blocked"), F.when(F.col("stage") == S4, F.col("mainnet_live_at")).alias("mainnet_announced_for"),
        F.lit(0.0).alias("risk"),
    )
    df = feats.join(facts.join(geo, "candidate_id"), "candidate_id")
    df = feature_columns(df, rules).withColumn("fit", F.col("total_score"))
    live_at = F.col("mainnet_live_at")
    df = df.withColumn("lead_time_days", (epoch(live_at) - epoch(F.col("first_evidence_at"))) / 86400.0)
    df = score_columns(df.withColumn("mainnet_live_at", F.lit(None).cast("timestamp")).withColumn("_live", live_at), F.col("cutoff"), rules)
    return df.select(
        F.col("candidate_id").alias("name"), *keys[1:], "ordinal", "is_positive", "expected_label", "first_eligible_signal", F.col("_live").alias("mainnet_live_at"),
        "state", F.round("confidence", 2).alias("confidence"), F.round("outreach_score", 2).alias("outreach_score"), F.round("radar_score", 2).alias("radar_score"),
        "label", F.col("total_score").alias("fit"), "gate_passed", "lead_time_days",
    )


def _ratio(n: Column, d: Column, default: float) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d), F.lit(default))


def backtest_metrics(results: DataFrame, by: tuple[str, ...] = ("cutoff",)) -> DataFrame:
    """Recall, false promotions, precision at 20, label precision and median lead per run."""
    keys = list(by)
    # Three aggregates read the results, which are costly to make.
    results = cut_lineage(results.select(*keys, "state", "is_positive", "label", "expected_label", "lead_time_days", "radar_score", "ordinal"))
    promoted = F.col("state").isin(*PROMOTED)
    pos = F.col("is_positive")
    explicit = F.col("label").startswith("A1") | F.col("label").startswith("A2")
    right = F.col("expected_label").startswith("A1") | F.col("expected_label").startswith("A2")
    agg = results.groupBy(*keys).agg(
        F.count("*").alias("total_evaluated"),
        F.count_if(pos).alias("detected_positives"),
        F.count_if(pos & promoted).alias("promoted_positives"),
        F.count_if(~pos & promoted).alias("false_promotions"),
        F.count_if(~pos).alias("_neg"),
        F.count_if(pos & explicit).alias("_lab"),
        F.count_if(pos & explicit & right).alias("_ok"),
    )
    leads = values_at_ranks(results.filter(pos), keys, "lead_time_days", **MIDDLE)
    median = leads.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median_lead_time_days"))
    top = top_n(results, keys, [F.col("radar_score").desc(), F.col("ordinal")], PRECISION_AT)
    prec = top.groupBy(*keys).agg(F.avg(F.when(pos, 1.0).otherwise(0.0)).alias("precision_at_20"))
    return agg.join(prec, keys).join(median, keys, "left").select(
        *keys, "total_evaluated", "detected_positives", "promoted_positives",
        _ratio(F.col("promoted_positives"), F.col("detected_positives"), 0.0).alias("positive_recall"),
        "false_promotions", _ratio(F.col("false_promotions"), F.col("_neg"), 0.0).alias("false_promotion_rate"),
        "precision_at_20", _ratio(F.col("_ok"), F.col("_lab"), 1.0).alias("label_precision"), "median_lead_time_days",
    )


def cutoff_sweep(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Sweep summary (B4): recall, false promotions, median and p90 days to discovery, median lead.

    The p90 is the element at ``floor(0.9·(n−1))`` of the sorted lags.
    """
    first = results.filter(F.col("state").isin(*PROMOTED)).groupBy("name").agg(F.min("cutoff").alias("promoted_at"))
    df = corpus.select("name", "is_positive", "first_eligible_signal", "mainnet_live_at").join(first, "name", "left")
    day = lambda a, b: F.floor((epoch(a) - epoch(b)) / 86400.0)
    hit = F.col("promoted_at").isNotNull()
    df = df.withColumn("lag", F.when(F.col("is_positive"), day(F.col("promoted_at"), F.col("first_eligible_signal")))).withColumn(
        "lead", F.when(F.col("is_positive"), day(F.col("mainnet_live_at"), F.col("promoted_at")))
    )
    agg = df.agg(
        _ratio(F.count_if(F.col("is_positive") & hit), F.count_if("is_positive"), 0.0).alias("positive_recall"),
        _ratio(F.count_if(~F.col("is_positive") & hit), F.count_if(~F.col("is_positive")), 0.0).alias("false_promotion_rate"),
    )
    lags = values_at_ranks(df, [], "lag", **MIDDLE, _p90=lambda n: F.floor(F.lit(0.9) * (n - 1)))
    leads = values_at_ranks(df, [], "lead", **MIDDLE)
    middle = (F.col("_low") + F.col("_high")) / 2
    one = lambda d: d.withColumn("_j", F.lit(1))
    lags = lags.select(middle.alias("median_time_to_discovery_days"), F.col("_p90").cast("double").alias("p90_time_to_discovery_days"))
    leads = leads.select(middle.alias("median_lead_days"))
    return one(agg).join(one(lags), "_j", "left").join(one(leads), "_j", "left").drop("_j")


def first_seen(results: DataFrame) -> DataFrame:
    """First cutoff at which each fixture was visible and promoted."""
    return results.groupBy("name").agg(
        F.min("cutoff").alias("first_seen"), F.min(F.when(F.col("state").isin(*PROMOTED), F.col("cutoff"))).alias("first_promoted")
    )


def detected(corpus: DataFrame, results: DataFrame) -> DataFrame:
    """Fixtures promoted at any cutoff: corpus ∩ promoted (SO2)."""
    names = results.filter(F.col("state").isin(*PROMOTED)).select("name")
    return corpus.select("name").intersect(names).join(corpus.select("name", "is_positive"), "name")


def source_ablation(results: DataFrame) -> DataFrame:
    """Recall lost per removed family against the baseline ``""``."""
    m = backtest_metrics(results, ("cutoff", "ablation"))
    base = m.filter(F.col("ablation") == "").select("cutoff", F.col("positive_recall").alias("_base"))
    return m.filter(F.col("ablation") != "").join(base, "cutoff").select(
        "cutoff", F.col("ablation").alias("family"), F.col("positive_recall").alias("recall_without"),
        (F.col("_base") - F.col("positive_recall")).alias("recall_delta"), F.col("precision_at_20").alias("precision_at_20_without"),
        F.col("detected_positives").alias("detected_positives_without"), (F.col("_base") - F.col("positive_recall") > 1e-9).alias("unique_contributor"),
    )
