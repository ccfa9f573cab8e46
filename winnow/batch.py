"""One batch from raw items to the ranked queue.

    enabled raw items -> new evidence -> observations -> organisations and candidates -> assessments
    -> review tasks and risk signals -> scores -> queue

Each step is an operator of this library; the batch only connects them and carries what the next one needs. What a batch
leaves behind (``State``) is what it takes: tables that grow by appended rows, and the components of the two resolutions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.timefn import ts
from winnow.operators import assess as A
from winnow.operators import geography as G
from winnow.operators import ledger as L
from winnow.operators import normalize as N
from winnow.operators import resolve as R
from winnow.operators import score as S
from winnow.operators import verify as V
from winnow.session import cut_lineage
from winnow.settings import DEFAULT, Rules

Job = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    """``evidence`` is the ledger, ``observations`` carry org_id and candidate_id, ``features`` one row for each observation with text."""

    evidence: DataFrame
    observations: DataFrame
    features: DataFrame
    organizations: R.Components
    candidates: R.Components
    snapshots: DataFrame


@dataclass(frozen=True)
class Outcome:
    """The new rows of a batch, the tables it recomputes, and the state for the next batch."""

    new_evidence: DataFrame
    tasks: DataFrame
    signals: DataFrame
    assessments: DataFrame
    candidates: DataFrame
    snapshots: DataFrame
    state: State


def resolved_observations(new: DataFrame, old: State | None) -> tuple[DataFrame, R.Components, R.Components]:
    """All observations with org_id and candidate_id after a batch, and the components of both.

    The batch meets stored components only. Where it gives earlier observations another organisation, the candidates,
    whose identifiers contain it, are resolved anew.
    """
    orgs = R.organization_batch(new, old.organizations if old else None)
    fresh = R.with_network_identity(orgs.resolved)
    organizations = orgs.applied_to(old.organizations if old else None)
    if old is None:
        cands = R.candidate_batch(fresh, None)
        return cands.resolved, organizations, cands.applied_to(None)
    changed = cut_lineage(orgs.changed)
    if changed.isEmpty():
        cands = R.candidate_batch(fresh, old.candidates)
        renamed = cands.changed.withColumnsRenamed({"old_key": "candidate_id", "new_key": "_new"})
        kept = old.observations.join(renamed, "candidate_id", "left").withColumn("candidate_id", F.coalesce("_new", "candidate_id")).drop("_new")
        return kept.unionByName(cands.resolved), organizations, cands.applied_to(old.candidates)
    renamed = changed.withColumnsRenamed({"old_key": "org_id", "new_key": "_new"})
    kept = old.observations.drop("candidate_id").join(renamed, "org_id", "left").withColumn("org_id", F.coalesce("_new", "org_id")).drop("_new")
    cands = R.candidate_batch(kept.unionByName(fresh), None)
    return cands.resolved, organizations, cands.applied_to(None)


def review_work(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open review tasks (J5, J9, J10, J11) and active risk signals (J12) of all observations."""
    claims = obs.select("caip2", F.col("org_id").alias("organization_id"), "candidate_id", "observed_at", "evidence_id")
    networks = R.network_key(obs)
    inc = R.incarnations(networks)
    owner = networks.groupBy("network_id").agg(F.min("candidate_id").alias("candidate_id"))
    resets = inc.select(F.col("incarnation_id").alias("superseded_by_id"), F.col("first_seen_at").alias("at"), F.col("evidence_id").alias("by"))
    resets = inc.filter("status = 'superseded'").join(resets, "superseded_by_id").join(owner, "network_id")
    none = F.lit(None).cast("string")
    collisions = R.caip2_collisions(claims)
    changes = R.chain_id_changes(networks).join(owner, "network_id")
    tasks = (
        collisions.select("task_type", "candidate_id", "related_candidate_id", F.concat(F.lit("caip2:"), "caip2").alias("evidence_id"), F.col("created_at").alias("at"))
        .unionByName(changes.select("task_type", "candidate_id", none.alias("related_candidate_id"), F.concat(F.lit("chain:"), "observed").alias("evidence_id"), F.col("created_at").alias("at")))
        .unionByName(resets.select(F.lit("network_reset_or_collision").alias("task_type"), "candidate_id", none.alias("related_candidate_id"), F.col("by").alias("evidence_id"), "at"))
    )
    signals = R.collision_signals(claims).unionByName(
        resets.select("candidate_id", F.lit("genesis_changed").alias("signal_type"), "at", F.col("by").alias("evidence_id"))
    )
    return R.upsert_review_tasks(tasks), R.upsert_signals(signals)


def candidate_facts(obs: DataFrame, assessments: DataFrame, signals: DataFrame, probes: DataFrame | None, as_of, rules: Rules = DEFAULT) -> DataFrame:
    """One row per candidate with all that a score needs besides its evidence."""
    order = F.struct("observed_at", "evidence_id")
    some = lambda c: F.coalesce(F.bool_or(F.size(c) > 0), F.lit(False))
    at = lambda env: F.coalesce(F.bool_or((F.col("environment") == env) & F.col("is_public")), F.lit(False))
    named = obs.groupBy("candidate_id").agg(
        F.min_by("candidate_name", order).alias("canonical_name"), F.min_by("slug", order).alias("slug"), F.min("org_id").alias("organization_id"),
        F.min_by("stack_family", order).alias("stack_family"), some("organization_domains").alias("has_domain"), some("github_orgs").alias("has_repo"),
        some("rpc_urls").alias("has_rpc"), at("testnet").alias("has_public_testnet"), at("testnet").alias("has_testnet"), at("devnet").alias("has_devnet"),
        F.coalesce(F.bool_or(F.coalesce("genesis_fingerprint", F.lit("")) != ""), F.lit(False)).alias("verified_genesis"),
    )
    staged = S.lifecycle_stage(named.join(S.lifecycle_timestamps(obs), "candidate_id"), as_of, rules)
    labels = obs.select("candidate_id", F.explode("purpose_labels").alias("label"))
    networks = R.rollup_networks(R.network_key(obs))
    token = A.token_only(named, networks, R.network_urls(R.network_key(obs)), labels)
    if probes is None:
        seen = named.select("candidate_id", F.lit(False).alias("has_fingerprint"), F.lit(False).alias("identity_mismatch"), F.lit(0).alias("endpoint_failures")).limit(0)
    else:
        seen = V.verification_summary(probes).select("candidate_id", "has_fingerprint", "identity_mismatch", "endpoint_failures")
    facts = A.risk_scores(A.risk_facts(staged, signals, seen, token))
    facts = facts.join(seen.select("candidate_id", "has_fingerprint"), "candidate_id", "left").withColumn("hard_blocked", F.coalesce("token_only", F.lit(False)))
    found = assessments.select("candidate_id", F.col("intent_label").alias("label"), F.col("total_score").alias("fit"))
    return facts.join(found, "candidate_id", "left")


def run_batch(
    raw: DataFrame, register: DataFrame, jobs: Sequence[Job], lexicon: DataFrame, as_of, old: State | None = None,
    probes: DataFrame | None = None, overrides: DataFrame | None = None, rules: Rules = DEFAULT,
) -> Outcome:
    """Process a batch of raw items on top of ``old``.

    ``register`` lists the sources with tier and kill switch; each of ``jobs`` turns the evidence it knows into observations; ``probes``
    and ``overrides`` are all that are on record. Items that are already in the ledger add nothing, so a batch that is repeated leaves the state as it was.
    """
    new = cut_lineage(L.append_evidence(L.enabled_items(raw, register), old.evidence if old else None))
    evidence = new if old is None else old.evidence.unionByName(new)
    envelope = new.drop("reliability", "observed_bucket")  # the jobs set their own reliability
    fresh = cut_lineage(N.union_observations(*[job(envelope) for job in jobs]))
    obs, organizations, candidates = resolved_observations(fresh, old)
    obs = cut_lineage(obs)

    family = new.groupBy("source_id", F.col("external_id").alias("evidence_id")).agg(F.first("source_family").alias("source_family"))
    flagged = A.source_flags(fresh.join(family, ["source_id", "evidence_id"], "left"), register)
    docs = flagged.filter(F.col("raw_text").isNotNull()).select(
        F.concat_ws("/", "source_id", "evidence_id").alias("doc_id"), F.col("raw_text").alias("text"), "is_official_source", F.when(F.col("is_activity"), True).alias("has_funding_or_activity"),
    )
    features = G.africa_features(docs, lexicon, rules=rules)
    features = cut_lineage(features if old is None else old.features.unionByName(features))
    at = obs.select(F.concat_ws("/", "source_id", "evidence_id").alias("doc_id"), "candidate_id", "observed_at", "evidence_id")
    assessments = cut_lineage(A.rollup_assessments(features.join(at, "doc_id"), overrides))

    tasks, signals = (cut_lineage(x) for x in review_work(obs))
    cands = cut_lineage(candidate_facts(obs, assessments, signals, probes, as_of, rules))
    families = evidence.groupBy("source_id", F.col("external_id").alias("evidence_id")).agg(F.first("source_family").alias("source_family"))
    trail = obs.select("candidate_id", "source_id", "evidence_id", "observed_at").join(families, ["source_id", "evidence_id"])
    snapshots = cut_lineage(S.score_candidates(cands, trail, ts(as_of), old.snapshots if old else None, rules))
    return Outcome(new, tasks, signals, assessments, cands, snapshots, State(evidence, obs, features, organizations, candidates, snapshots))


def ranked_queue(snapshots: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` candidates by state, outreach score and id (O1)."""
    priority = S.lookup({"HOT": 1, "QUALIFIED": 2, "RADAR": 3, "STALE": 4, "REJECT": 5}, F.col("state"), 6)
    return snapshots.orderBy(priority, F.col("outreach_score").desc(), "candidate_id").limit(limit)
