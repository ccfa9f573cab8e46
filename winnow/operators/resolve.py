"""Entity resolution: organisations, candidates, networks, incarnations, collisions and tasks.

Records merge over shared technical or official identifiers only, never over a name. Identifier
sets are linked by connected components, so the result does not depend on arrival order. Lists that
can grow without bound (identifiers, URLs, evidence references) stay rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from winnow.functions.components import connected_components
from winnow.functions.once import spread, with_once
from winnow.functions.ordered import previous_by_range, top_n, with_next_mark
from winnow.functions.text import (
    caip2, chain_id, channel_hash, default_namespace, domain, key_text, normalize_name, root_name, slug, stable_key,
)
from winnow.session import cut_lineage

# Weights of a match, kept as labels on review tasks.
WEIGHT_GENESIS, WEIGHT_DOMAIN, WEIGHT_GITHUB = 1.00, 0.95, 0.85
WEIGHT_CHAIN_ID, WEIGHT_NAME = 0.85, 0.40


@dataclass(frozen=True)
class Components:
    """What a resolution has to know of earlier batches: ``labels`` (node, component) and ``heads`` (component, first).

    A component is named by its smallest node; ``first`` is its first observation, whose own key is the key of all.
    """

    labels: DataFrame
    heads: DataFrame


@dataclass(frozen=True)
class Resolution:
    """A resolved batch, and what it changes: ``labels`` and ``heads`` are rows to upsert in ``Components``, ``merged`` names components that are no more,
    and ``changed`` (old_key, new_key) tells which keys of earlier observations have become another one."""

    resolved: DataFrame
    labels: DataFrame
    heads: DataFrame
    merged: DataFrame
    changed: DataFrame

    def applied_to(self, old: Components | None) -> Components:
        """The components after the batch, for the next one."""
        if old is None:
            return Components(self.labels, self.heads)
        labels = old.labels.join(self.labels.select("node"), "node", "left_anti").unionByName(self.labels)
        gone = self.merged.unionByName(self.heads.select("component")).distinct()
        return Components(labels, old.heads.join(gone, "component", "left_anti").unionByName(self.heads))


def _group_by_nodes(obs: DataFrame, nodes: str, own_key: Column, key: str, old: Components | None = None) -> Resolution:
    """Add ``key``: the own key of the first observation in each observation's component. ``own_key`` is its text, which equal
    sets of identifiers share; it becomes a key once for each set.

    Distinct sets of identifiers enter the graph, each node already replaced by its component in ``old``, so rounds run on
    what the batch links and not on what is stored. An observation without any identifier is a component of its own.
    """
    row = F.concat(F.lit("row:"), F.col("evidence_id").cast("string"))
    # In steps, each evaluated once: what refers to an array twice would compute it twice.
    obs = with_once(obs, _ids=F.array_sort(F.array_distinct(F.array_compact(F.col(nodes)))))
    obs = with_once(obs, _ids_=F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(F.array(F.coalesce(row, F.lit("row:"))))).drop("_ids").withColumnRenamed("_ids_", "_ids")
    # Identifiers come from names and URLs by regular expressions: written once, they are not worked out again for the last join.
    obs = cut_lineage(obs)
    sets = obs.groupBy("_ids").agg(F.min(F.struct("observed_at", "evidence_id", F.coalesce(own_key, row).alias("own"))).alias("first"))
    sets = sets.select("_ids", "first.observed_at", "first.evidence_id", stable_key(F.col("first.own")).alias("own"))
    sets = cut_lineage(sets.select("_ids", F.struct("observed_at", "evidence_id", "own").alias("first"), F.get("_ids", F.lit(0)).alias("anchor")))
    members = sets.select("anchor", F.explode("_ids").alias("node"))
    known = members.select("node").distinct()
    if old is None:
        known = known.withColumn("label", F.col("node"))
        links = members.select(F.col("anchor").alias("src"), F.col("node").alias("dst"))
    else:
        known = cut_lineage(known.join(old.labels, "node", "left").select("node", "component", F.coalesce("component", "node").alias("label")))
        a, b = known.select(F.col("node").alias("anchor"), F.col("label").alias("src")), known.select("node", F.col("label").alias("dst"))
        links = members.filter("anchor <> node").join(a, "anchor").join(b, "node").select("src", "dst")
    joined = connected_components(links).select(F.col("node").alias("label"), "component")
    if old is None:
        named = known.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    else:
        named = known.withColumnRenamed("component", "was").join(joined, "label", "left").select("node", "was", F.coalesce("component", "label").alias("component"))
    named = cut_lineage(named)
    firsts = sets.join(named.select(F.col("node").alias("anchor"), "component"), "anchor").select("component", "first")
    if old is None:
        heads = cut_lineage(firsts.groupBy("component").agg(F.min("first").alias("first")))
        labels, nothing = named, heads.limit(0)
        merged, changed = nothing.select("component"), nothing.select(F.col("first.own").alias("old_key"), F.col("first.own").alias("new_key"))
    else:
        # Stored components that the batch touches, under their old and their new name.
        moved = cut_lineage(named.filter("was IS NOT NULL").select("was", "component").distinct())
        before = old.heads.join(moved.select(F.col("was").alias("component"), F.col("component").alias("new")), "component")
        before = cut_lineage(before.select("component", "new", "first"))
        both = firsts.unionByName(before.select(F.col("new").alias("component"), "first"))
        heads = cut_lineage(both.groupBy("component").agg(F.min("first").alias("first")))
        other = moved.filter("was <> component")
        relabelled = old.labels.join(other.select(F.col("was").alias("component"), F.col("component").alias("new")), "component").select("node", F.col("new").alias("component"))
        labels = cut_lineage(named.filter("was IS NULL").select("node", "component").unionByName(relabelled))
        merged = other.select(F.col("was").alias("component"))
        now = heads.select(F.col("component").alias("new"), F.col("first.own").alias("new_key"))
        changed = before.select("new", F.col("first.own").alias("old_key")).join(now, "new").filter("old_key <> new_key").select("old_key", "new_key").distinct()
    keys = named.join(heads, "component").select(F.col("node").alias("_anchor"), F.col("first.own").alias(key))
    resolved = obs.withColumn("_anchor", F.get("_ids", F.lit(0))).join(keys, "_anchor").drop("_anchor", "_ids")
    return Resolution(resolved, labels, heads, merged, changed)


def resolve_organizations(obs: DataFrame, shared_domains: tuple[str, ...] = (), unicode: str = "full") -> DataFrame:
    """Observations with ``org_id``.

    A shared official domain or GitHub organisation links; a name is the key only where neither was
    observed, and the evidence id where there is no name either. ``shared_domains`` lists hosting domains that identify nobody.
    """
    return organization_batch(obs, None, shared_domains, unicode).resolved


def organization_batch(obs: DataFrame, old: Components | None, shared_domains: tuple[str, ...] = (), unicode: str = "full") -> Resolution:
    """``resolve_organizations`` of a batch on top of the stored components of all batches before."""
    none = F.array().cast("array<string>")
    doms = F.array_compact(F.transform(F.coalesce("organization_domains", none), domain))
    doms = F.array_sort(F.array_distinct(F.filter(doms, lambda d: ~d.isin(*shared_domains)) if shared_domains else doms))
    gits = F.transform(F.coalesce("github_orgs", none), lambda g: F.trim(g))
    gits = F.array_sort(F.array_distinct(F.filter(gits, lambda g: g != "")))
    display = F.coalesce(F.nullif(F.col("organization_name"), F.lit("")), F.col("candidate_name"))
    df = with_once(spread(obs), _d=doms, _g=gits, _name=slug(display, unicode))
    named = F.array(F.concat(F.lit("name:"), "_name"))
    ids = F.concat(
        F.transform("_d", lambda x: F.concat(F.lit("domain:"), x)), F.transform("_g", lambda x: F.concat(F.lit("github:"), x))
    )
    df = with_once(df, _nodes=F.when(F.size("_d") + F.size("_g") > 0, ids).otherwise(named))
    key = (
        F.when(F.size("_d") > 0, key_text(F.lit("org"), F.lit("domain"), F.get("_d", F.lit(0))))
        .when(F.size("_g") > 0, key_text(F.lit("org"), F.lit("github"), F.get("_g", F.lit(0))))
        .otherwise(key_text(F.lit("org"), F.lit("name"), F.col("_name")))
    )
    out = _group_by_nodes(df, "_nodes", key, "org_id", old)
    return replace(out, resolved=out.resolved.drop("_nodes", "_d", "_g", "_name"))


def merge_org_attrs(resolved: DataFrame) -> DataFrame:
    """(org_id, kind, value) for domains, GitHub organisations, locations and social handles.

    Sets are distinct rows; a handle per platform is the latest observed.
    """
    none = F.array().cast("array<string>")
    of = lambda kind, values: F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    kinds = [of("domain", F.col("organization_domains")), of("github", F.col("github_orgs"))]
    if "claimed_locations" in resolved.columns:
        kinds.append(of("location", F.col("claimed_locations")))
    # Raw values repeat: they are told apart in one pass over the observations, and only then cut to domains.
    rows = resolved.select("org_id", F.inline(F.concat(*kinds))).distinct()
    value = F.when(F.col("kind") == "domain", domain(F.col("value"))).when(F.col("kind") == "github", F.trim("value")).otherwise(F.col("value"))
    rows = rows.select("org_id", "kind", value.alias("value")).filter(F.coalesce("value", F.lit("")) != "").distinct()
    if "social_handles" in resolved.columns:
        social = resolved.select("org_id", "observed_at", "evidence_id", F.explode("social_handles").alias("p", "value"))
        last = social.groupBy("org_id", F.concat(F.lit("social:"), "p").alias("kind")).agg(
            F.max_by("value", F.struct("observed_at", "evidence_id")).alias("value")
        )
        rows = rows.unionByName(last)
    return rows


def with_network_identity(obs: DataFrame, unicode: str = "full") -> DataFrame:
    """Observations with canonical slug, chain id, namespace and CAIP-2."""
    ns = F.coalesce("protocol_namespace", default_namespace(F.col("stack_family")))
    named = slug(F.col("candidate_name"), unicode)
    if "candidate_slug" in obs.columns:
        named = F.coalesce(F.nullif(F.col("candidate_slug"), F.lit("")), named)
    given = F.nullif(F.col("caip2"), F.lit("")) if "caip2" in obs.columns else F.lit(None).cast("string")
    df = with_once(obs.withColumnRenamed("human_chain_id", "_raw_id"), slug=named, _id=chain_id(F.col("_raw_id")), _ns=ns, _given=given)
    cid = F.nullif(F.col("_id"), F.lit(""))
    return df.select(
        *[c for c in obs.columns if c not in ("human_chain_id", "protocol_namespace", "caip2")],
        "slug",
        cid.alias("human_chain_id"),
        F.col("_ns").alias("protocol_namespace"),
        F.coalesce("_given", caip2(F.col("_ns"), cid)).alias("caip2"),
    )


def resolve_candidates(obs: DataFrame) -> DataFrame:
    """Observations with ``candidate_id`` (J3): verified genesis under one CAIP-2 links across
    organisations, a CAIP-2 only within one, and otherwise organisation and slug decide. An observation
    that has none of these is a candidate of its own."""
    return candidate_batch(obs, None).resolved


def candidate_batch(obs: DataFrame, old: Components | None) -> Resolution:
    """``resolve_candidates`` of a batch on top of the stored components of all batches before."""
    org = F.col("org_id")
    nodes = F.array_compact(
        F.array(
            F.concat(F.lit("s:"), org, F.lit(":"), "slug"),
            F.concat(F.lit("n:"), org, F.lit(":"), "caip2"),
            F.concat(F.lit("g:"), "caip2", F.lit(":"), F.nullif(F.col("genesis_fingerprint"), F.lit(""))),
        )
    )
    out = _group_by_nodes(with_once(spread(obs), _nodes=nodes), "_nodes", key_text(org, F.col("slug")), "candidate_id", old)
    return replace(out, resolved=out.resolved.drop("_nodes"))


def caip2_collisions(claims: DataFrame) -> DataFrame:
    """Review tasks for a CAIP-2 claimed by several organisations.

    ``claims`` holds (caip2, organization_id, candidate_id, observed_at). Each later claimant gets
    one task against the first claimant; ``claimants`` tells how many organisations claim the id.
    The pairs of later claimants follow from the claim rows and are not spelled out, so work and
    output grow with the claims, not with their square.
    """
    per_org = claims.filter(F.col("caip2").isNotNull()).groupBy("caip2", "organization_id").agg(
        F.min(F.struct("observed_at", "candidate_id")).alias("c")
    )
    first = per_org.groupBy("caip2").agg(
        F.min(F.struct(F.col("c.observed_at").alias("at"), F.col("organization_id").alias("org"), F.col("c.candidate_id").alias("cand"))).alias("f"),
        F.count("*").alias("claimants"),
    ).filter(F.col("claimants") > 1)
    return per_org.join(first, "caip2").filter(F.col("organization_id") != F.col("f.org")).select(
        F.lit("chain_id_collision").alias("task_type"),
        "caip2",
        F.col("f.cand").alias("candidate_id"),
        F.col("c.candidate_id").alias("related_candidate_id"),
        F.col("c.observed_at").alias("created_at"),
        F.lit(WEIGHT_CHAIN_ID).alias("match_weight"),
        "claimants",
    )


def collision_signals(claims: DataFrame) -> DataFrame:
    """Risk signals (candidate_id, signal_type, at, evidence_id) of claimants that a later organisation contradicts.

    ``claims`` holds (caip2, organization_id, candidate_id, observed_at, evidence_id). Every claimant but the last one of an id gets one,
    with the time and evidence of that last claim.
    """
    per_org = claims.filter(F.col("caip2").isNotNull()).groupBy("caip2", "organization_id").agg(
        F.min(F.struct("observed_at", "candidate_id", "evidence_id")).alias("c")
    )
    last = per_org.groupBy("caip2").agg(F.max(F.struct(F.col("c.observed_at").alias("at"), F.col("organization_id").alias("org"), F.col("c.evidence_id").alias("by"))).alias("l"))
    return per_org.join(last, "caip2").filter(F.col("organization_id") != F.col("l.org")).select(
        F.col("c.candidate_id").alias("candidate_id"), F.lit("chain_id_collision").alias("signal_type"), F.col("l.at").alias("at"), F.col("l.by").alias("evidence_id")
    )


def weak_name_matches(candidates: DataFrame, unicode: str = "full") -> DataFrame:
    """Review tasks for a name another organisation already has as an alias.

    ``candidates`` holds (candidate_id, organization_id, canonical_name, aliases, first_seen_at).
    Each candidate is set against the earliest holder of its name in another organisation; per
    alias only the first holders of two organisations are needed for that, so a very common name
    costs one row per candidate.
    """
    held = candidates.select(
        F.explode(F.array_distinct(F.concat("aliases", F.array(normalize_name(F.col("canonical_name"), unicode))))).alias("alias"),
        "organization_id", "candidate_id", "first_seen_at",
    )
    per_org = held.groupBy("alias", "organization_id").agg(F.min(F.struct("first_seen_at", "candidate_id")).alias("h"))
    ranked = top_n(per_org, ["alias"], [F.col("h.first_seen_at"), F.col("h.candidate_id")], 2, rank="rn")
    two = ranked.groupBy("alias").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("organization_id", "h"))).alias("a"),
        F.max(F.when(F.col("rn") == 2, F.struct("organization_id", "h"))).alias("b"),
    )
    mine = candidates.select(
        normalize_name(F.col("canonical_name"), unicode).alias("alias"), "candidate_id", "organization_id", "first_seen_at"
    ).filter(F.col("alias") != "")
    other = F.when(F.col("a.organization_id") != F.col("organization_id"), F.col("a.h")).otherwise(F.col("b.h"))
    df = mine.join(two, "alias").withColumn("_o", other)
    return df.filter(F.struct("first_seen_at", "candidate_id") > F.col("_o")).select(
        F.lit("weak_name_match").alias("task_type"),
        "alias",
        F.col("_o.candidate_id").alias("candidate_id"),
        F.col("candidate_id").alias("related_candidate_id"),
        F.lit(WEIGHT_NAME).alias("match_weight"),
    )


def candidate_aliases(resolved: DataFrame, unicode: str = "full") -> DataFrame:
    """(candidate_id, kind, value): aliases from names, their normal and root forms, and purpose
    labels (J7). The root form is an alias of the first observation only."""
    name = F.col("candidate_name")
    none = F.array().cast("array<string>")
    labels = F.coalesce("purpose_labels", none) if "purpose_labels" in resolved.columns else none
    # Names and labels repeat: each is looked at once for a candidate, and the observations are read once.
    names = resolved.groupBy("candidate_id", "candidate_name", labels.alias("_labels")).agg(F.min(F.struct("observed_at", "evidence_id")).alias("at"))
    names = cut_lineage(names)
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    rows = names.select("candidate_id", F.inline(F.concat(of("alias", F.array(name, normalize_name(name, unicode))), of("purpose", F.col("_labels")))))
    first = names.groupBy("candidate_id").agg(F.min_by("candidate_name", "at").alias("n"))
    rows = rows.unionByName(first.select("candidate_id", F.lit("alias").alias("kind"), root_name(F.col("n"), unicode).alias("value")))
    return rows.filter(F.coalesce("value", F.lit("")) != "").distinct()


def network_key(obs: DataFrame) -> DataFrame:
    return obs.withColumn("network_id", stable_key(F.col("candidate_id"), F.col("environment"), F.col("protocol_namespace")))


def rollup_networks(obs: DataFrame) -> DataFrame:
    """One row per network with the first non-null ids."""
    order = F.struct("observed_at", "evidence_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return obs.groupBy("network_id").agg(
        F.min_by("candidate_id", order).alias("candidate_id"),
        F.min_by("environment", order).alias("environment"),
        F.min_by("protocol_namespace", order).alias("protocol_namespace"),
        F.min_by("is_public", order).alias("is_public"),
        first("caip2"),
        first("human_chain_id"),
    )


def network_urls(obs: DataFrame) -> DataFrame:
    """Distinct (network_id, candidate_id, kind, url) of all observations."""
    out = None
    for kind, col in (("rpc", "rpc_urls"), ("explorer", "explorer_urls"), ("faucet", "faucet_urls")):
        part = obs.select("network_id", "candidate_id", F.lit(kind).alias("kind"), F.explode(col).alias("url"))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("url").isNotNull()).distinct()


def network_claims(obs: DataFrame) -> DataFrame:
    """Latest value per network and claim key."""
    rows = obs.select("network_id", "observed_at", "evidence_id", F.explode("claims").alias("claim", "value"))
    return rows.groupBy("network_id", "claim").agg(F.max_by("value", F.struct("observed_at", "evidence_id")).alias("value"))


def chain_id_changes(obs: DataFrame) -> DataFrame:
    """Review tasks for networks that later report another chain id (J9): one per observed id."""
    seen = obs.filter(F.col("human_chain_id").isNotNull()).groupBy("network_id", "human_chain_id").agg(
        F.min(F.struct("observed_at", "evidence_id")).alias("at"), F.count("*").alias("observations")
    )
    stored = seen.groupBy("network_id").agg(F.min(F.struct("at", "human_chain_id"))["human_chain_id"].alias("stored"))
    return seen.join(stored, "network_id").filter(F.col("human_chain_id") != F.col("stored")).select(
        F.lit("chain_id_changed").alias("task_type"), "network_id", "stored", F.col("human_chain_id").alias("observed"),
        F.col("at.observed_at").alias("created_at"), "observations", F.lit(WEIGHT_CHAIN_ID).alias("match_weight"),
    )


def incarnations(obs: DataFrame) -> DataFrame:
    """One row per verified genesis of a network; a later genesis supersedes the one before.

    Genesis values are reduced to their first sighting before they are ordered.
    """
    g = obs.filter(F.coalesce("genesis_fingerprint", F.lit("")) != "").groupBy("network_id", "genesis_fingerprint").agg(
        F.min(F.struct("observed_at", "evidence_id")).alias("f")
    )
    g = g.select("network_id", "genesis_fingerprint", F.col("f.observed_at").alias("first_seen_at"), F.col("f.evidence_id").alias("evidence_id"))
    g = g.withColumn("incarnation_id", stable_key(F.col("network_id"), F.col("genesis_fingerprint")))
    after = previous_by_range(g, ["network_id"], ["first_seen_at", "evidence_id"], ["incarnation_id"])
    by = after.filter(F.col("prev_incarnation_id").isNotNull()).select(
        F.col("prev_incarnation_id").alias("incarnation_id"), F.col("incarnation_id").alias("superseded_by_id")
    )
    return g.join(by, "incarnation_id", "left").select(
        "network_id", "incarnation_id", "genesis_fingerprint", "first_seen_at", "evidence_id", "superseded_by_id",
        F.when(F.col("superseded_by_id").isNull(), F.lit("active")).otherwise(F.lit("superseded")).alias("status"),
    )


def reset_tasks(inc: DataFrame) -> DataFrame:
    """Review tasks and ``genesis_changed`` signals for superseded incarnations."""
    return inc.filter(F.col("status") == "superseded").select(
        F.lit("network_reset_or_collision").alias("task_type"),
        "network_id",
        F.col("incarnation_id").alias("previous_id"),
        F.col("superseded_by_id").alias("related_candidate_id"),
        F.lit("genesis_changed").alias("signal_type"),
        F.lit(WEIGHT_GENESIS).alias("match_weight"),
    )


TASK_KEY = ("task_type", "candidate_id", "related_candidate_id")


def upsert_review_tasks(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One open task per (type, candidate, counterparty).

    Rows carry (key, evidence_id, at). The task keeps its first time and the number of distinct
    references; the references themselves are ``task_refs``. No counterparty is ``""``.
    """
    rows = task_refs(new, existing)
    return rows.groupBy(*TASK_KEY).agg(
        F.min("at").alias("created_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("n_evidence"), F.lit("open").alias("status")
    )


def task_refs(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct evidence references per open task with their first time."""
    rows = new.select(*TASK_KEY, "evidence_id", "at")
    if existing is not None:
        rows = rows.unionByName(existing.select(*TASK_KEY, "evidence_id", "at"))
    rows = rows.withColumn("related_candidate_id", F.coalesce("related_candidate_id", F.lit("")))
    return rows.groupBy(*TASK_KEY, "evidence_id").agg(F.min("at").alias("at"))


def upsert_signals(new: DataFrame) -> DataFrame:
    """One active risk signal per (candidate, type)."""
    return new.groupBy("candidate_id", "signal_type").agg(
        F.min("at").alias("first_at"), F.count_distinct("evidence_id").alias("n_evidence"),
        F.lit("negative").alias("polarity"), F.lit(1.0).alias("strength"), F.lit(True).alias("active"),
    )


def drop_suppressed(contacts: DataFrame, suppressions: DataFrame, value: str = "channel_value") -> DataFrame:
    """Contacts whose channel is not suppressed."""
    hashed = contacts.withColumn("channel_hash", channel_hash(F.col(value)))
    return hashed.join(suppressions.select("channel_hash"), "channel_hash", "left_anti")


def upsert_contacts(new: DataFrame, existing: DataFrame | None = None, value: str = "channel_value") -> DataFrame:
    """New contacts, one per (channel, organisation), null organisations being equal."""
    hashed = new.filter(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn("channel_hash", channel_hash(F.col(value)))
    one = top_n(hashed, ["channel_hash", "org_id"], [F.col("contact_id")])
    if existing is None:
        return one
    e = existing.select(F.col("channel_hash").alias("_h"), F.col("org_id").alias("_o"))
    return one.join(e, (F.col("channel_hash") == F.col("_h")) & F.col("org_id").eqNullSafe(F.col("_o")), "left_anti")


def numbered_cutoffs(cutoffs: DataFrame, few: int = 256) -> DataFrame:
    """(cutoff, k, last_k): the distinct cutoffs in order, from 1 on. Up to ``few`` of them become a local table; they are
    few beside the results at each of them in any case."""
    marks = cutoffs.select(F.col("cutoff").cast("timestamp").alias("cutoff")).filter(F.col("cutoff").isNotNull()).distinct()
    listed = sorted(r[0] for r in marks.limit(few + 1).collect())
    if len(listed) <= few:
        rows = [(c, k, len(listed)) for k, c in enumerate(listed, 1)]
        return cutoffs.sparkSession.createDataFrame(rows, "cutoff timestamp, k int, last_k int")
    w = W.partitionBy(F.lit(0))
    return marks.select("cutoff", F.row_number().over(w.orderBy("cutoff")).alias("k"), F.count("*").over(w).cast("int").alias("last_k"))


def visible_events(events: DataFrame, cutoffs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Events visible at each cutoff.

    The first cutoff that sees a moment is found once for each distinct moment, by a sweep; events meet it in an equi-join and
    are repeated for the cutoffs from there on, which is what the result holds. ``excluded`` holds (ablation, source_family) rows;
    ablation ``""`` is the baseline. Its distinct names travel with the plan as one array, all of them.
    """
    numbered = numbered_cutoffs(cutoffs)
    moments = events.select("observed_at").filter(F.col("observed_at").isNotNull()).distinct()
    moments = moments.select("observed_at", F.col("observed_at").alias("_t"), F.lit(False).alias("_late"))
    first = with_next_mark(moments, numbered.select("cutoff"), []).select("observed_at", F.col("_mark").alias("cutoff"))
    first = first.join(numbered, "cutoff").select("observed_at", F.explode(F.sequence("k", "last_k")).alias("k"))
    seen = events.join(first, "observed_at").join(numbered.select("cutoff", "k"), "k").select(*events.columns, "cutoff")
    if excluded is None:
        return seen
    names = json.dumps([r[0] for r in excluded.select("ablation").distinct().orderBy("ablation").collect()])
    seen = seen.select("*", F.explode(F.from_json(F.lit(names), "array<string>")).alias("ablation"))
    return seen.filter((F.col("ablation") == "") | (F.col("source_family") != F.col("ablation")))


def candidate_documents(candidates: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Candidates with their child rows as JSON (J22), long form (candidate_id, section, key, doc).

    Sections stay rows, so a candidate with very many children is many rows and not one huge one;
    written partitioned by candidate hash, a reader gets all parts of one candidate together.
    """
    out = candidates.select("candidate_id", F.lit("candidate").alias("section"), F.lit("").alias("key"), F.to_json(F.struct("*")).alias("doc"))
    for name, (df, key) in children.items():
        out = out.unionByName(
            df.select("candidate_id", F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("doc"))
        )
    return out


def org_bridges(obs: DataFrame) -> DataFrame:
    """Review rows for observations that join identifiers first seen apart.

    Such an observation merges organisations that stood alone before it; the merge is visible here.
    """
    none = F.array().cast("array<string>")
    ids = F.concat(
        F.transform(F.array_compact(F.transform(F.coalesce("organization_domains", none), domain)), lambda x: F.concat(F.lit("domain:"), x)),
        F.transform(F.coalesce("github_orgs", none), lambda x: F.concat(F.lit("github:"), F.trim(x))),
    )
    rows = obs.select("evidence_id", "observed_at", F.explode(F.array_distinct(ids)).alias("node"))
    first = rows.groupBy("node").agg(F.min(F.struct("observed_at", "evidence_id")).alias("f"))
    own = F.struct("observed_at", "evidence_id")
    return (
        rows.join(first, "node").filter(F.col("f") < own)
        .groupBy("evidence_id")
        .agg(F.count_distinct(F.col("f.evidence_id")).alias("n"), F.min("node").alias("first_node"), F.max("node").alias("other_node"))
        .filter(F.col("n") > 1)
        .select(F.lit("org_bridge").alias("task_type"), "evidence_id", "first_node", "other_node")
    )
