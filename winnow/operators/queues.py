"""Queues, top-k windows, histories and reports over candidates, scores and funding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordered import top_n, with_previous
from winnow.functions.timefn import age_days, ts
from winnow.operators.score import lookup
from winnow.settings import DEFAULT, Rules

# Queue priority of a state; anything else sorts last with 6.
STATE_PRIORITY = {"HOT": 1, "QUALIFIED": 2, "RADAR": 3, "STALE": 4, "REJECT": 5}


# -- windows ---------------------------------------------------------------------------------


def latest_per_channel(activity: DataFrame) -> DataFrame:
    """Newest snapshot per (candidate, channel)."""
    return top_n(activity, ["candidate_id", "channel"], [F.col("observed_at").desc(), F.col("snapshot_id").desc()])


def latest_round(rounds: DataFrame) -> DataFrame:
    """Newest funding round per candidate; an undated round only wins alone."""
    return top_n(rounds, ["candidate_id"], [F.col("announced_at").desc_nulls_last(), F.col("round_id")])


def top_evidence(evidence: DataFrame, n: int = 15) -> DataFrame:
    """Newest ``n`` evidence rows per candidate with their position."""
    return top_n(evidence, ["candidate_id"], [F.col("observed_at").desc(), F.col("evidence_id")], n, rank="position")


def current_scores(snapshots: DataFrame) -> DataFrame:
    """Current snapshot per candidate (W7): history is never joined, only this row."""
    return top_n(snapshots, ["candidate_id"], [F.col("calculated_at").desc(), F.col("snapshot_id").desc()])


def score_history(snapshots: DataFrame, candidate_ids=None) -> DataFrame:
    """All snapshots with ``is_current``; for given candidates, newest first."""
    if candidate_ids is not None:
        snapshots = snapshots.filter(F.col("candidate_id").isin(list(candidate_ids)))
    current = snapshots.groupBy("candidate_id").agg(
        F.max(F.struct("calculated_at", "snapshot_id"))["snapshot_id"].alias("_cur")
    )
    out = (
        snapshots.join(current, "candidate_id")
        .withColumn("is_current", F.col("snapshot_id") == F.col("_cur"))
        .drop("_cur")
    )
    return out if candidate_ids is None else out.orderBy("candidate_id", F.col("calculated_at").desc(), F.col("snapshot_id").desc())


def hot_transitions(snapshots: DataFrame, slice_seconds: int = 30 * 86400) -> DataFrame:
    """Snapshots that turn HOT after a state other than HOT."""
    prev = with_previous(snapshots, ["candidate_id"], "calculated_at", ["snapshot_id"], ["state"], slice_seconds)
    return prev.filter((F.col("state") == "HOT") & ~F.col("prev_state").eqNullSafe("HOT"))


def verification_trail(probes: DataFrame, limit: int = 50) -> DataFrame:
    """Newest ``limit`` probes per candidate."""
    return top_n(probes, ["candidate_id"], [F.col("observed_at").desc(), F.col("probe_id").desc()], limit, rank="position")


# -- joins and filters -----------------------------------------------------------------------


def with_current_score(candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Candidates with their current snapshot."""
    cur = current_scores(snapshots).select(
        "candidate_id", "snapshot_id", "state", "workflow_state", "outreach_score", "radar_score",
        "confidence", "risk", "calculated_at",
    )
    return candidates.join(cur, "candidate_id", "left")


def filter_funding(
    candidates: DataFrame,
    rounds: DataFrame,
    has_funding: bool | None = None,
    since=None,
    until=None,
    min_amount: float | None = None,
) -> DataFrame:
    """Candidates with a round that meets all conditions, or with any or no round."""
    if since is not None or until is not None or min_amount is not None:
        cond: Column = F.lit(True)
        if since is not None:
            cond &= F.col("announced_at") >= ts(since)
        if until is not None:
            cond &= F.col("announced_at") <= ts(until)
        if min_amount is not None:
            cond &= F.col("amount_usd") >= min_amount
        return candidates.join(rounds.filter(cond).select("candidate_id"), "candidate_id", "left_semi")
    if has_funding is None:
        return candidates
    return candidates.join(rounds.select("candidate_id"), "candidate_id", "left_semi" if has_funding else "left_anti")


def find_orgs(orgs: DataFrame, domain: str | None = None, name: str | None = None) -> DataFrame:
    """Organisation by official domain, else by display or legal name without case."""
    hits = []
    if domain:
        hits.append(orgs.filter(F.array_contains("official_domains", domain)).withColumn("_rank", F.lit(1)))
    if name:
        n = name.lower().strip()
        hits.append(
            orgs.filter((F.lower("display_name") == n) | (F.lower("legal_name") == n)).withColumn("_rank", F.lit(2))
        )
    if not hits:
        return orgs.limit(0)
    out = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    return out.orderBy("_rank", "org_id").limit(1).drop("_rank")


def find_candidates(candidates: DataFrame, networks: DataFrame, key: str) -> DataFrame:
    """Candidates by id, slug, CAIP-2 or chain id."""
    by_net = networks.filter((F.col("caip2") == key) | (F.col("human_chain_id") == key)).select("candidate_id")
    direct = candidates.filter((F.col("candidate_id").cast("string") == key) | (F.col("slug") == key)).select("candidate_id")
    ids = direct.unionByName(by_net).distinct()
    return candidates.join(ids, "candidate_id", "left_semi")


def pending_verification(candidates: DataFrame, network_urls: DataFrame, probes: DataFrame, limit: int = 20) -> DataFrame:
    """Candidates with a published RPC endpoint and no probe yet, newest first."""
    rpc = network_urls.filter(F.col("kind") == "rpc").select("candidate_id")
    return (
        candidates.join(rpc, "candidate_id", "left_semi")
        .join(probes.filter(F.col("candidate_id").isNotNull()).select("candidate_id"), "candidate_id", "left_anti")
        .orderBy(F.col("first_seen_at").desc(), "candidate_id")
        .limit(limit)
    )


def candidate_filter(
    df: DataFrame,
    state: str | None = None,
    workflow_state: str | None = None,
    label: str | None = None,
    stack_family: str | None = None,
    search: str | None = None,
    verified_only: bool = False,
) -> DataFrame:
    """The list filters of the candidate queue on joined rows."""
    for col, value in (
        ("state", state), ("workflow_state", workflow_state), ("intent_label", label), ("stack_family", stack_family),
    ):
        if value:
            df = df.filter(F.col(col) == value)
    if search:
        q = search.lower()
        df = df.filter(F.lower("canonical_name").contains(q) | F.lower("slug").contains(q))
    if verified_only:
        df = df.filter(F.col("last_verified_at").isNotNull())
    return df


def joined_candidates(
    candidates: DataFrame, snapshots: DataFrame, assessments: DataFrame, rounds: DataFrame, funding: dict | None = None, **filters
) -> DataFrame:
    """Candidates with score, label and funding totals, filtered.

    Filters on candidate columns run before the joins, so pruned candidates are never shuffled.
    """
    own = {k: filters.get(k) for k in ("stack_family", "search", "verified_only") if filters.get(k)}
    rest = {k: v for k, v in filters.items() if k not in own}
    cands = candidate_filter(candidates, **own)
    if funding:
        cands = filter_funding(cands, rounds, **funding)
    df = with_current_score(cands, snapshots).join(
        assessments.select("candidate_id", "intent_label", "total_score"), "candidate_id", "left"
    )
    df = candidate_filter(df, **rest)
    return df.join(funding_totals(rounds), "candidate_id", "left")


def queue_order() -> list[Column]:
    """State priority, newest funding, outreach, funding total, first seen, then id (O1)."""
    return [
        lookup(STATE_PRIORITY, F.col("state"), 6),
        F.col("latest_funding_at").desc_nulls_last(),
        F.col("outreach_score").desc_nulls_last(),
        F.coalesce("total_funding_usd", F.lit(0.0)).desc(),
        F.col("first_seen_at").desc(),
        F.col("candidate_id"),
    ]


def candidate_queue(
    candidates: DataFrame, snapshots: DataFrame, assessments: DataFrame, rounds: DataFrame,
    limit: int = 50, offset: int = 0, **filters,
) -> DataFrame:
    """The analyst's queue (O1)."""
    df = joined_candidates(candidates, snapshots, assessments, rounds, **filters)
    out = df.orderBy(*queue_order())
    return (out.offset(offset) if offset else out).limit(limit)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1, clamped) of ``size`` rows in a total order (O2)."""
    n = max(1, number)
    return df.orderBy(*order).offset((n - 1) * size).limit(size)


def count_candidates(
    candidates: DataFrame, snapshots: DataFrame, assessments: DataFrame, rounds: DataFrame,
    approximate: bool = False, **filters,
) -> DataFrame:
    """Full number of candidates the queue filters match."""
    df = joined_candidates(candidates, snapshots, assessments, rounds, **filters)
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(f("candidate_id").alias("n_candidates"))


def enrichment_queue(candidates: DataFrame, snapshots: DataFrame, limit: int = 25) -> DataFrame:
    """Active candidates by outreach score (O3)."""
    df = candidates.join(
        current_scores(snapshots).filter(F.col("state").isin("HOT", "QUALIFIED", "RADAR")).select("candidate_id", "state", "outreach_score"),
        "candidate_id",
    )
    return df.orderBy(F.col("outreach_score").desc(), "candidate_id").limit(limit)


def recheck_queue(probes: DataFrame, as_of, limit: int = 50, rules: Rules = DEFAULT) -> DataFrame:
    """First-round successes older than the minimum wait whose endpoint has no second observation,
    oldest first (O4). The pair filter runs before the limit, so no endpoint starves.

    An endpoint with a single observation is found by counting, not by a window.
    """
    single = probes.groupBy("endpoint_hash").agg(
        F.count("*").alias("_n"),
        *[F.any_value(c).alias(c) for c in probes.columns if c != "endpoint_hash"],
    )
    return (
        single.filter((F.col("_n") == 1) & (F.col("probe_round") == 1) & F.col("success"))
        .filter(F.col("observed_at") <= ts(as_of) - F.expr(f"interval {rules.recheck_min_seconds} seconds"))
        .orderBy("observed_at", "endpoint_hash")
        .limit(limit)
        .drop("_n")
    )


def list_rounds(rounds: DataFrame, candidate_id) -> DataFrame:
    """Rounds of one candidate, newest first."""
    return rounds.filter(F.col("candidate_id") == candidate_id).orderBy(F.col("announced_at").desc_nulls_last(), "round_id")


def list_review_tasks(
    tasks: DataFrame, status: str = "open", task_type: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Review tasks, newest first."""
    if status != "all":
        tasks = tasks.filter(F.col("status") == status)
    if task_type:
        tasks = tasks.filter(F.col("task_type") == task_type)
    out = tasks.orderBy(F.col("created_at").desc(), "task_id")
    return (out.offset(offset) if offset else out).limit(limit)


def list_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """Dispatched alerts, newest first, with display time."""
    from winnow.functions.timefn import display_tz

    out = alerts.orderBy(F.col("dispatched_at").desc(), "alert_id").limit(limit)
    return out.withColumn("dispatched_at_display", F.date_format(display_tz(F.col("dispatched_at")), "yyyy-MM-dd HH:mm"))


# -- reports ---------------------------------------------------------------------------------


def funding_totals(rounds: DataFrame) -> DataFrame:
    """Funding total and newest date per candidate (A5), one aggregate instead of subqueries."""
    return rounds.groupBy("candidate_id").agg(
        F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("total_funding_usd"),
        F.max("announced_at").alias("latest_funding_at"),
        F.count("*").alias("rounds_count"),
    )


def funnel(candidates: DataFrame, snapshots: DataFrame, assessments: DataFrame, history: bool = False) -> DataFrame:
    """Counts by state, workflow state, label and stack family as (dimension, value, n) (A1).

    Each dimension is one small aggregate; ``history`` counts every snapshot instead of the current.
    """
    scores = snapshots if history else current_scores(snapshots)
    both = scores.groupBy("state", "workflow_state").agg(F.count("*").alias("n"))

    def dim(df: DataFrame, name: str, col: str, n: Column) -> DataFrame:
        return df.groupBy(F.col(col).alias("value")).agg(n.alias("n")).select(F.lit(name).alias("dimension"), "value", "n")

    one = F.count("*")
    return (
        dim(both, "pipeline_state", "state", F.sum("n"))
        .unionByName(dim(both, "workflow_state", "workflow_state", F.sum("n")))
        .unionByName(dim(assessments, "intent_label", "intent_label", one))
        .unionByName(dim(candidates, "stack_family", "stack_family", one))
    )


def region_matrix(assessments: DataFrame) -> DataFrame:
    """Candidates per country and per region from the assessment arrays (A2)."""

    def part(kind: str, col: str) -> DataFrame:
        return assessments.select(F.lit(kind).alias("kind"), F.explode(col).alias("name"))

    return part("country", "countries").unionByName(part("region", "regions")).groupBy("kind", "name").agg(F.count("*").alias("n"))


def priority_markets(assessments: DataFrame, countries: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Candidates per priority market, markets without any included (A3)."""
    markets = countries.filter(F.col("iso2").isin(*rules.priority_markets)).select("iso2", F.col("name").alias("country"))
    counts = assessments.select(F.explode("countries").alias("country")).groupBy("country").agg(F.count("*").alias("n"))
    return markets.join(counts, "country", "left").select(
        "iso2", "country", F.coalesce("n", F.lit(0).cast("bigint")).alias("chain_count")
    )


def calibration_report(snapshots: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Trailing-week snapshot counts by state and rule version with averages (A4).

    Long form (section, key, n, value); ``config_changed`` is 1 when more than one version scored.
    """
    week = snapshots.filter(
        (F.col("calculated_at") <= ts(as_of)) & (F.col("calculated_at") >= ts(as_of) - F.expr(f"interval {days} days"))
    )
    cells = week.groupBy("state", "rule_version").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("outreach_score").alias("o"), F.sum("risk").alias("r")
    )
    null = F.lit(None).cast("double")
    states = cells.groupBy(F.col("state").alias("key")).agg(F.sum("n").alias("n")).select(F.lit("state").alias("section"), "key", "n", null.alias("value"))
    versions = cells.groupBy(F.col("rule_version").alias("key")).agg(F.sum("n").alias("n")).select(F.lit("rule_version").alias("section"), "key", "n", null.alias("value"))
    total = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), F.sum("c").alias("c"), F.sum("o").alias("o"), F.sum("r").alias("r"),
        F.count_distinct("rule_version").alias("v"),
    )
    avg = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    rows = F.array(
        F.struct(F.lit("average").alias("section"), F.lit("confidence").alias("key"), F.col("n").alias("n"), avg("c").alias("value")),
        F.struct(F.lit("average").alias("section"), F.lit("outreach_score").alias("key"), F.col("n").alias("n"), avg("o").alias("value")),
        F.struct(F.lit("average").alias("section"), F.lit("risk").alias("key"), F.col("n").alias("n"), avg("r").alias("value")),
        F.struct(F.lit("config_changed").alias("section"), F.lit("rule_versions").alias("key"), F.col("v").alias("n"), F.when(F.col("v") > 1, 1.0).otherwise(0.0).alias("value")),
    )
    return states.unionByName(versions).unionByName(total.select(F.inline(rows)))


def open_tasks_by_type(tasks: DataFrame) -> DataFrame:
    """Open review tasks per type."""
    return tasks.filter(F.col("status") == "open").groupBy("task_type").agg(F.count("*").alias("n"))


def kpis(snapshots: DataFrame, assessments: DataFrame) -> DataFrame:
    """Dashboard figures: HOT, QUALIFIED, RADAR and STALE, and explicit intent."""
    s = current_scores(snapshots).agg(
        F.count_if(F.col("state") == "HOT").alias("hot"),
        F.count_if(F.col("state") == "QUALIFIED").alias("qualified"),
        F.count_if(F.col("state").isin("RADAR", "STALE")).alias("radar_stale"),
    )
    a = assessments.agg(F.count_if(F.col("intent_label").startswith("A1") | F.col("intent_label").startswith("A2")).alias("explicit_intent"))
    # Two one-row aggregates side by side.
    return s.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")


def activity_points(candidates: DataFrame, links: DataFrame, networks: DataFrame, network_urls: DataFrame) -> DataFrame:
    """0–5 activity points from links, networks, RPC and verification, and their band."""
    n_links = links.groupBy("candidate_id").agg(F.count("*").alias("_l"))
    n_nets = networks.groupBy("candidate_id").agg(F.count("*").alias("_n"))
    rpc = network_urls.filter(F.col("kind") == "rpc").groupBy("candidate_id").agg(F.lit(1).alias("_r"))
    df = candidates.join(n_links, "candidate_id", "left").join(n_nets, "candidate_id", "left").join(rpc, "candidate_id", "left")
    zero = F.lit(0)
    pts = (
        F.least(F.coalesce("_l", zero), F.lit(2))
        + F.least(F.coalesce("_n", zero), F.lit(1))
        + F.coalesce("_r", zero)
        + F.when(F.col("last_verified_at").isNotNull(), 1).otherwise(0)
    ).cast("bigint")
    band = (
        F.when(F.col("activity_points") >= 4, "high").when(F.col("activity_points") >= 3, "med")
        .when(F.col("activity_points") >= 2, "low").when(F.col("activity_points") >= 1, "min").otherwise("none")
    )
    return df.withColumn("activity_points", pts).withColumn("activity_band", band).drop("_l", "_n", "_r")


def format_usd(total: Column, rounds: Column) -> Column:
    """Money band text: ``$1.2B``, ``$3.4M``, ``$5K``, ``undisc.`` or a dash (A10)."""
    return (
        F.when(total >= 1e9, F.format_string("$%.1fB", total / 1e9))
        .when(total >= 1e6, F.format_string("$%.1fM", total / 1e6))
        .when(total > 0, F.format_string("$%.0fK", total / 1e3))
        .when(rounds > 0, F.lit("undisc."))
        .otherwise(F.lit("—"))
    )


def probe_outcomes(probes: DataFrame) -> DataFrame:
    """Probes per day and failure class, ``success`` for those without."""
    return probes.groupBy(
        F.to_date("observed_at").alias("day"),
        F.when(F.col("success"), F.lit("success")).otherwise(F.coalesce("failure_class", F.lit("unreachable"))).alias("outcome"),
    ).agg(F.count("*").alias("n"))


def enrichment_totals(rounds: DataFrame) -> DataFrame:
    """Chains, rounds and disclosed sum of an enrichment run."""
    per = rounds.groupBy("candidate_id").agg(F.count("*").alias("n"), F.sum("amount_usd").alias("u"))
    return per.agg(
        F.count("*").alias("chains"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("rounds"),
        F.coalesce(F.sum("u"), F.lit(0.0)).alias("total_usd"),
    )


def list_view(queue: DataFrame, networks: DataFrame, rounds: DataFrame, investors: DataFrame) -> DataFrame:
    """Rows of the candidate list (A13): first chain id, funding total, newest round, lead, label.

    ``investors`` is (round_id, position, investor); the lead falls back to the first investor of
    the first round when the newest round names none.
    """
    from winnow.session import cut_lineage

    # The page is a few rows used in several joins: compute the queue once.
    queue = cut_lineage(queue)
    ids = queue.select("candidate_id")
    chain = (
        networks.join(ids, "candidate_id", "left_semi")
        .filter(F.col("human_chain_id").isNotNull())
        .groupBy("candidate_id")
        .agg(F.min_by("human_chain_id", "network_id").alias("chain_id"))
    )
    mine = rounds.join(ids, "candidate_id", "left_semi")
    newest = latest_round(mine).select(
        "candidate_id", F.col("announced_at").alias("raised_on"), F.col("lead_investor").alias("_lead")
    )
    first = mine.groupBy("candidate_id").agg(F.min("round_id").alias("round_id"))
    fallback = first.join(investors.filter(F.col("position") == 0).select("round_id", "investor"), "round_id").select(
        "candidate_id", F.col("investor").alias("_first_investor")
    )
    df = queue.join(chain, "candidate_id", "left").join(newest, "candidate_id", "left").join(fallback, "candidate_id", "left")
    total = F.coalesce("total_funding_usd", F.lit(0.0))
    return df.select(
        "candidate_id",
        F.substring("canonical_name", 1, 24).alias("name"),
        F.substring(F.coalesce("chain_id", F.lit("—")), 1, 8).alias("chain_id"),
        F.upper("stack_family").alias("stack"),
        F.substring_index(F.coalesce("intent_label", F.lit("A4_no_evidence")), "_", 1).alias("label"),
        format_usd(total, F.coalesce("rounds_count", F.lit(0))).alias("raised"),
        F.coalesce(F.date_format("raised_on", "yyyy-MM-dd"), F.lit("—")).alias("raised_on"),
        F.substring(F.coalesce("_lead", "_first_investor", F.lit("—")), 1, 16).alias("lead"),
        F.coalesce("outreach_score", F.lit(0.0)).alias("outreach"),
        F.coalesce("radar_score", F.lit(0.0)).alias("radar"),
        F.coalesce("state", F.lit("—")).alias("state"),
    )
