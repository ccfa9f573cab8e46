"""Lifecycle, confidence, momentum, composites, gate, staleness, state and snapshots.

All scores derive from one pass over the evidence: a first aggregate per (candidate, source,
family) combines on the map side, a second per candidate sees only those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.timefn import age_days, parse_ts, ts
from winnow.settings import DEFAULT, Rules

# Lifecycle stages.
S0, S1, S2 = "S0_research_hint", "S1_devnet_prototype", "S2_public_testnet"
S3, S4 = "S3_incentivized_testnet", "S4_mainnet_announced"
S5, S6 = "S5_early_mainnet", "S6_established_archived"
OUTREACH_STAGES = (S2, S3, S4, S5)
# Regional-intent labels that state the project's own intent.
EXPLICIT_LABELS = ("A1_explicit_intent", "A2_active_regional_motion")
# Claims whose first non-null value wins, and claims that only date the first sight.
FIRST_WINS = (
    "repo_created_at", "first_commit_at", "domain_first_seen_at", "registry_pr_opened_at",
    "registry_merged_at", "testnet_announced_at", "mainnet_live_at",
)
LAST_PRESENT_WINS = "mainnet_announced_for"
SIGHT_CLAIMS = ("published_at", "first_seen_at", "created_at")
# Claims tried in order for the first sight of a new candidate.
INITIAL_SIGHT = (
    "first_seen_at", "published_at", "repo_created_at", "created_at", "first_commit_at",
    "registry_pr_opened_at",
)
# Families that are no independent origin.
NOT_INDEPENDENT = ("unknown", "")


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """A small fixed dict as a map literal."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.try_element_at(m, key)
    return got if default is None else F.coalesce(got, F.lit(default))


# -- lifecycle -------------------------------------------------------------------------------


def initial_first_seen(observations: DataFrame) -> DataFrame:
    """First sight claimed by each observation: first readable of six claims, else its own time."""
    got = F.coalesce(*[parse_ts(F.col("claims")[k]) for k in INITIAL_SIGHT], F.col("observed_at"))
    return observations.withColumn("initial_first_seen", got)


def lifecycle_timestamps(observations: DataFrame) -> DataFrame:
    """Lifecycle timestamps per candidate from its claims.

    First non-null claim wins, except ``mainnet_announced_for``: there the last observation that
    carries the key wins, even with a null. ``first_seen_at`` is the earliest of all sights.
    """
    order = F.struct("observed_at", "evidence_id")

    def claim(k: str) -> Column:
        return parse_ts(F.col("claims")[k])

    aggs = [F.min_by(claim(k), F.when(claim(k).isNotNull(), order)).alias(k) for k in FIRST_WINS]
    has = F.map_contains_key(F.col("claims"), F.lit(LAST_PRESENT_WINS))
    aggs.append(F.max_by(claim(LAST_PRESENT_WINS), F.when(has, order)).alias(LAST_PRESENT_WINS))
    aggs += [F.min(claim(k)).alias(f"_{k}") for k in SIGHT_CLAIMS]
    first = F.coalesce(*[claim(k) for k in INITIAL_SIGHT], F.col("observed_at"))
    aggs.append(F.min_by(first, order).alias("_initial"))
    aggs.append(F.max(F.coalesce(F.col("claims")["has_incentive"] == "true", F.lit(False))).alias("has_incentive"))
    sights = ["_initial", *[f"_{k}" for k in SIGHT_CLAIMS]] + [
        k for k in FIRST_WINS if k not in ("registry_merged_at", "mainnet_live_at")
    ]
    out = observations.groupBy("candidate_id").agg(*aggs)
    return out.withColumn("first_seen_at", F.least(*[F.col(c) for c in sights])).drop(
        "_initial", *[f"_{k}" for k in SIGHT_CLAIMS]
    )


def lifecycle_stage(candidates: DataFrame, as_of, rules: Rules = DEFAULT) -> DataFrame:
    """Stage S0–S6 by decision list (R2). ``candidates`` carries the R1 columns, ``has_incentive``,
    and the network facts ``has_public_testnet`` and ``has_devnet``."""
    live = F.col("mainnet_live_at")
    stage = (
        F.when(live >= ts(as_of) - F.expr(f"interval {rules.early_mainnet_days} days"), S5)
        .when(live.isNotNull(), S6)
        .when(F.col("mainnet_announced_for").isNotNull(), S4)
        .when(F.col("has_incentive"), S3)
        .when(F.col("testnet_announced_at").isNotNull() | F.col("has_public_testnet"), S2)
        .when(
            F.col("registry_pr_opened_at").isNotNull()
            | F.col("repo_created_at").isNotNull()
            | F.col("has_devnet"),
            S1,
        )
        .otherwise(S0)
    )
    return candidates.withColumn("stage", stage)


# -- evidence features -----------------------------------------------------------------------


def evidence_features(
    evidence: DataFrame,
    as_of,
    rules: Rules = DEFAULT,
    keys: tuple[str, ...] = ("candidate_id",),
    family_alias: dict | None = None,
) -> DataFrame:
    """All a score needs from the evidence, per candidate (R4, R5, parts of R6, R7, R10).

    Rows after ``as_of`` do not count. ``as_of`` may be a column, so that many cutoffs are replayed
    in one job. ``family_alias`` maps family names before they are looked up.
    """
    cut = ts(as_of)
    ev = evidence.filter(F.col("observed_at") <= cut)
    if family_alias:
        ev = ev.withColumn(
            "source_family", F.coalesce(lookup(family_alias, F.col("source_family")), "source_family")
        )
    recent = age_days(F.col("observed_at"), cut) <= F.lit(float(rules.momentum_days))
    extra = [F.max(cut).alias("_as_of")]
    per_source = ev.groupBy(*keys, "source_id", "source_family").agg(
        F.max("observed_at").alias("last_at"),
        F.min("observed_at").alias("first_at"),
        F.count("*").alias("n"),
        F.count_if(recent).alias("n_recent"),
        *extra,
    )
    half = dict(rules.half_life_days)
    hl = lookup({k: v for k, v in half.items() if k != "default"}, F.col("source_family"), half["default"])
    age = F.greatest(age_days(F.col("last_at"), F.col("_as_of")), F.lit(0.0))
    fresh = F.lit(10.0) * F.pow(F.lit(0.5), age / hl)
    fam = F.col("source_family")
    independent = fam.isNotNull() & ~fam.isin(*NOT_INDEPENDENT)
    live = F.col("n_recent") > 0
    return per_source.groupBy(*keys).agg(
        F.max("last_at").alias("latest_evidence_at"),
        F.min("first_at").alias("first_evidence_at"),
        F.sum("n").alias("evidence_count"),
        F.sum("n_recent").alias("recent_count"),
        F.count_distinct(F.when(live, F.col("source_id"))).alias("recent_sources"),
        F.coalesce(F.bool_or(live & fam.isin("careers", "social")), F.lit(False)).alias("recent_commercial"),
        F.count_distinct(F.when(independent, fam)).alias("n_families"),
        F.coalesce(F.bool_or(fam == "registry"), F.lit(False)).alias("has_registry_evidence"),
        F.max(fresh).alias("freshness"),
    )


def family_freshness(evidence: DataFrame, as_of, rules: Rules = DEFAULT) -> DataFrame:
    """Decayed freshness per candidate and family, long form of R5's map."""
    half = dict(rules.half_life_days)
    hl = lookup({k: v for k, v in half.items() if k != "default"}, F.col("source_family"), half["default"])
    last = (
        evidence.filter(F.col("observed_at") <= ts(as_of))
        .groupBy("candidate_id", F.coalesce("source_family", F.lit("unknown")).alias("source_family"))
        .agg(F.max("observed_at").alias("last_at"))
    )
    age = F.greatest(age_days(F.col("last_at"), as_of), F.lit(0.0))
    return last.select(
        "candidate_id", "source_family", (F.lit(10.0) * F.pow(F.lit(0.5), age / hl)).alias("freshness")
    )


def source_families(evidence: DataFrame) -> DataFrame:
    """Distinct independent families per candidate, one row each."""
    fam = F.col("source_family")
    return evidence.filter(fam.isNotNull() & ~fam.isin(*NOT_INDEPENDENT)).select(
        "candidate_id", "source_family"
    ).distinct()


# -- components ------------------------------------------------------------------------------


def attribution(df: DataFrame) -> DataFrame:
    """Official-attribution facts (R3) from ``has_domain``, ``has_repo``, ``has_social``."""
    record = F.col("registry_pr_opened_at").isNotNull() | F.col("registry_merged_at").isNotNull()
    official = F.col("has_domain") | F.col("has_repo") | F.col("has_social")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("has_domain"), F.lit("official domain")),
            F.when(F.col("has_repo"), F.lit("official repository")),
            F.when(F.col("has_social"), F.lit("verified official social handle")),
            F.when(record, F.lit("registry submission recorded")),
            F.when(~official, F.lit("no official domain, repository or verified handle")),
        )
    )
    return (
        df.withColumn("has_registry_record", record)
        .withColumn("officially_attributed", official)
        .withColumn("attribution_reasons", reasons)
    )


def _f(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def confidence(df: DataFrame) -> DataFrame:
    """Discovery confidence 0–100 and its six parts (R6); needs R3 and ``evidence_features``."""
    dom, repo = F.col("has_domain"), F.col("has_repo")
    c_attr = (
        F.when(dom & repo, 20.0).when(dom | repo, 15.0).when(F.col("has_social"), 8.0)
        .when(F.col("has_registry_record"), 4.0).otherwise(0.0)
    )
    c_reg = (
        F.when(F.col("registry_merged_at").isNotNull(), 15.0)
        .when(F.col("registry_pr_opened_at").isNotNull(), 10.0)
        .when(_f("has_registry_evidence", False), 8.0).otherwise(0.0)
    )
    genesis = F.col("verified_genesis")
    c_tech = (
        F.when(F.col("advancing_liveness") & genesis, 25.0)
        .when(F.col("has_fingerprint") & genesis, 20.0)
        .when(F.col("has_fingerprint"), 15.0)
        .when(F.col("has_rpc"), 6.0).otherwise(0.0)
    )
    n = _f("n_families", 0)
    c_corr = F.when(n == 0, 0.0).when(n == 1, 5.0).when(n == 2, 10.0).otherwise(15.0)
    c_life = (
        F.when(F.col("mainnet_live_at").isNotNull(), 15.0)
        .when(F.col("mainnet_announced_for").isNotNull(), 12.0)
        .when(F.col("testnet_announced_at").isNotNull() | F.col("has_testnet"), 10.0)
        .when(F.col("stage").isNotNull() & (F.col("stage") != S0), 6.0).otherwise(0.0)
    )
    c_fresh = F.round(_f("freshness", 0.0), 2)
    out = (
        df.withColumn("c_attribution", c_attr).withColumn("c_registry", c_reg)
        .withColumn("c_technical", c_tech).withColumn("c_corroboration", c_corr)
        .withColumn("c_lifecycle", c_life).withColumn("c_freshness", c_fresh)
    )
    parts = ["c_attribution", "c_registry", "c_technical", "c_corroboration", "c_lifecycle", "c_freshness"]
    return out.withColumn("confidence", F.least(F.lit(100.0), sum((F.col(p) for p in parts), F.lit(0.0))))


def momentum(df: DataFrame) -> DataFrame:
    """Momentum 0–100 and its four parts."""
    stage = F.col("stage")
    out = (
        df.withColumn("m_velocity", F.least(F.lit(35.0), F.lit(7.0) * _f("recent_count", 0)))
        .withColumn(
            "m_stage",
            F.when(stage.isin(S2, S3), 30.0).when(stage == S4, 35.0).when(stage == S5, 25.0).otherwise(10.0),
        )
        .withColumn("m_sources", F.least(F.lit(20.0), F.lit(5.0) * _f("recent_sources", 0)))
        .withColumn("m_commercial", F.when(_f("recent_commercial", False), 15.0).otherwise(5.0))
    )
    total = F.col("m_velocity") + F.col("m_stage") + F.col("m_sources") + F.col("m_commercial")
    return out.withColumn("momentum", F.least(F.lit(100.0), total))


def composite_scores(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Radar and outreach scores (R8) from confidence, momentum, ``fit`` and ``risk``."""
    c, m, a, r = (F.col(x) for x in ("confidence", "momentum", "fit", "risk"))
    return df.withColumn(
        "radar_score",
        clamp(rules.radar_momentum * m + rules.radar_confidence * c + rules.radar_fit * a),
    ).withColumn(
        "outreach_score",
        clamp(
            rules.outreach_confidence * c + rules.outreach_fit * a
            + rules.outreach_momentum * m - rules.outreach_risk * r
        ),
    )


def gate(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Outreach gate with its failure reasons."""
    corroborated = _f("n_families", 0) >= rules.gate_min_families
    failures = F.array_compact(
        F.array(
            F.when(F.col("confidence") < rules.gate_confidence_min, F.lit("confidence below minimum")),
            F.when(~F.col("officially_attributed"), F.lit("no official attribution")),
            F.when(
                ~(corroborated | F.col("has_fingerprint")),
                F.lit("needs technical verification or independent source families"),
            ),
            F.when(F.col("hard_blocked"), F.lit("hard blocked by policy")),
        )
    )
    return df.withColumn("gate_failures", failures).withColumn(
        "gate_passed", F.size("gate_failures") == 0
    )


def staleness(df: DataFrame, as_of, rules: Rules = DEFAULT) -> DataFrame:
    """``stale`` when there is no evidence or it is older than the stage's TTL."""
    age = age_days(F.col("latest_evidence_at"), as_of)
    ttl = lookup(dict(rules.stale_days), F.coalesce("stage", F.lit(S0)))
    return (
        df.withColumn("evidence_age_days", age)
        .withColumn("ttl_days", ttl)
        .withColumn("stale", F.col("latest_evidence_at").isNull() | F.coalesce(age > ttl, F.lit(False)))
    )


def candidate_state(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """State REJECT > STALE > HOT > QUALIFIED > RADAR, and the below-watch note."""
    passed = F.col("gate_passed")
    relevant = F.coalesce(
        F.col("stage").isin(*OUTREACH_STAGES) | F.col("label").isin(*EXPLICIT_LABELS), F.lit(False)
    )
    state = (
        F.when(F.col("hard_blocked"), "REJECT")
        .when(F.col("stale"), "STALE")
        .when(
            passed
            & (F.col("confidence") >= rules.hot_confidence_min)
            & (F.col("outreach_score") >= rules.hot_outreach_min)
            & (F.col("risk") < rules.hot_risk_max)
            & relevant,
            "HOT",
        )
        .when(
            passed
            & (F.col("confidence") >= rules.qualified_confidence_min)
            & (F.col("outreach_score") >= rules.qualified_outreach_min),
            "QUALIFIED",
        )
        .otherwise("RADAR")
    )
    return df.withColumn("state", state).withColumn(
        "below_watch", (F.col("state") == "RADAR") & (F.col("radar_score") < rules.radar_watch_min)
    )


FACT_DEFAULTS = {
    "has_domain": False, "has_repo": False, "has_social": False, "verified_genesis": False,
    "advancing_liveness": False, "has_fingerprint": False, "has_rpc": False, "has_testnet": False,
    "hard_blocked": False, "fit": 0.0, "risk": 0.0,
}
FACT_TIMES = (
    "registry_pr_opened_at", "registry_merged_at", "mainnet_live_at", "mainnet_announced_for",
    "testnet_announced_at",
)


def with_fact_defaults(df: DataFrame) -> DataFrame:
    """Fill facts nobody observed: absent evidence scores zero."""
    for name, value in FACT_DEFAULTS.items():
        got = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        df = df.withColumn(name, got)
    for name in FACT_TIMES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("timestamp"))
    for name in ("label", "stage"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def score_columns(df: DataFrame, as_of, rules: Rules = DEFAULT) -> DataFrame:
    """R3 and R6–R11 over rows that already carry facts and evidence features."""
    df = attribution(with_fact_defaults(df))
    df = composite_scores(momentum(confidence(df)), rules)
    return candidate_state(staleness(gate(df, rules), as_of, rules), rules)


def score_candidates(
    candidates: DataFrame,
    evidence: DataFrame,
    as_of,
    previous: DataFrame | None = None,
    rules: Rules = DEFAULT,
) -> DataFrame:
    """Score snapshots to append (R12): one row per candidate, stamped with time and rule version.

    Workflow state belongs to analysts and is carried over from ``previous`` current snapshots.
    """
    feats = evidence_features(evidence, as_of, rules)
    df = score_columns(candidates.join(feats, "candidate_id", "left"), as_of, rules)
    if previous is not None:
        prev = previous.select("candidate_id", F.col("workflow_state").alias("_wf"))
        df = df.join(prev, "candidate_id", "left")
        wf = F.coalesce("_wf", F.lit("NEW"))
    else:
        wf = F.lit("NEW")
    return stamp_rule_version(
        df.withColumn("workflow_state", wf).drop("_wf").withColumn("calculated_at", ts(as_of)), rules
    )


def stamp_rule_version(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Rows with the version of the rules that made them."""
    return df.withColumn("rule_version", F.lit(rules.version))


def reconcile(
    candidates: DataFrame, evidence: DataFrame, current: DataFrame, as_of, rules: Rules = DEFAULT,
    skip_rejected: bool = False,
) -> DataFrame:
    """Rescore and report how the result differs from the current snapshots.

    No alerts follow from it. ``skip_rejected`` is the staleness sweep.
    """
    if skip_rejected:
        candidates = candidates.join(
            current.filter(F.col("state") == "REJECT").select("candidate_id"), "candidate_id", "left_anti"
        )
    new = score_candidates(candidates, evidence, as_of, current, rules)
    old = current.select(
        "candidate_id",
        F.col("state").alias("old_state"),
        F.col("outreach_score").alias("old_outreach_score"),
    )
    return new.join(old, "candidate_id", "left").select(
        "candidate_id",
        "old_state",
        F.col("state").alias("new_state"),
        "old_outreach_score",
        F.col("outreach_score").alias("new_outreach_score"),
        (
            ~F.col("old_state").eqNullSafe(F.col("state"))
            | (F.abs(F.coalesce("old_outreach_score", F.lit(-1.0)) - F.col("outreach_score")) > 1e-9)
        ).alias("diverges"),
    )
