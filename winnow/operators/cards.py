"""Evidence cards, alert payloads, digests and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.timefn import iso_text
from winnow.operators.geography import A1, A2, A4
from winnow.operators.queues import funding_totals, queue_order, top_evidence

CARD_EVIDENCE = 15
# How many candidates of a state a digest lists.
DIGEST_LIMITS = {"HOT": 20, "QUALIFIED": 30, "RADAR": 20}


def recommendation(state: Column, label: Column, countries: Column) -> Column:
    """Next step by state and label."""
    where = F.when(F.size(countries) > 0, F.array_join(countries, ", ")).otherwise(F.lit("regional expansion"))
    return (
        F.when((state == "HOT") & label.isin(A1, A2), F.concat(F.lit("Write a launch brief covering "), where))
        .when(state == "HOT", F.lit("Have a person check readiness and possible entry points"))
        .when(state == "QUALIFIED", F.lit("Discuss in the daily digest"))
        .otherwise(F.lit("Keep watching"))
    )


def evidence_cards(candidates: DataFrame, evidence: DataFrame, rounds: DataFrame) -> DataFrame:
    """One card per candidate as JSON (P5).

    ``candidates`` carries identity, stage, label, countries, scores and state. The card nests only
    what is bounded: the newest fifteen evidence rows; rounds and contacts are sections of
    ``candidate_documents`` and appear here as totals.
    """
    newest = top_evidence(evidence, CARD_EVIDENCE)
    ev = newest.groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "evidence_id", "source_id", "source_family", iso_text(F.col("observed_at")).alias("observed_at")))).alias("_ev")
    )
    counts = evidence.groupBy("candidate_id").agg(F.count("*").alias("_n"))
    df = candidates.join(ev, "candidate_id", "left").join(counts, "candidate_id", "left").join(funding_totals(rounds), "candidate_id", "left")
    label = F.coalesce("intent_label", F.lit(A4))
    rec = recommendation(F.col("state"), label, F.coalesce("countries", F.array().cast("array<string>")))
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    card = F.struct(
        F.struct(
            "candidate_id", "canonical_name", "organization", "stage", "stack_family", "layer",
            iso_text(F.col("first_seen_at")).alias("discovered_at"), iso_text(F.col("last_verified_at")).alias("last_verified_at"),
        ).alias("header"),
        F.struct(
            n.alias("recent_signals_count"), F.get("_ev", F.lit(0))["observed_at"].alias("latest_event_time"),
            # Fixed value: wording of the highlight.
            F.concat(F.lit("New public signal detected from "), F.coalesce(F.get("_ev", F.lit(0))["source_id"], F.lit("registry"))).alias("highlight"),
        ).alias("why_now"),
        F.struct("caip2", F.col("human_chain_id").alias("chain_id"), F.coalesce("genesis_fingerprint", F.lit("pending_probe")).alias("genesis_fingerprint")).alias("identity"),
        F.struct(F.coalesce("total_funding_usd", F.lit(0.0)).alias("total_disclosed_usd"), F.coalesce("rounds_count", F.lit(0).cast("bigint")).alias("rounds_count")).alias("funding"),
        F.struct(label.alias("label"), F.coalesce("fit", F.lit(0.0)).alias("score"), "countries").alias("africa"),
        F.struct("confidence", "momentum", "risk", "radar_score", "outreach_score", "state").alias("scores"),
        rec.alias("recommendation"),
        F.col("_ev").alias("evidence"),
    )
    return df.select("candidate_id", "state", n.alias("evidence_count"), rec.alias("recommendation"), card.alias("card"))


def alert_payload(cards: DataFrame) -> DataFrame:
    """Payload of a HOT alert as JSON."""
    c = F.col("card")
    return cards.select(
        "candidate_id",
        F.to_json(
            F.struct(
                F.lit("candidate_hot_alert").alias("event"), "candidate_id", c["header"]["canonical_name"].alias("name"),
                c["header"]["organization"].alias("organization"), c["header"]["stage"].alias("stage"), c["header"]["stack_family"].alias("family"),
                c["africa"]["label"].alias("africa_label"), c["africa"]["score"].alias("africa_score"), c["africa"]["countries"].alias("countries"),
                c["scores"]["outreach_score"].alias("outreach_score"), c["scores"]["confidence"].alias("confidence"), "recommendation", "evidence_count",
            )
        ).alias("payload"),
    )


def render_markdown(cards: DataFrame) -> DataFrame:
    """Card as markdown text (P6), ready for ``write.text``."""
    c = F.col("card")
    h, i, a, s, f = c["header"], c["identity"], c["africa"], c["scores"], c["funding"]
    line = lambda k, v: F.concat(F.lit(f"- **{k}**: "), F.coalesce(v.cast("string"), F.lit("N/A")))
    sources = F.transform(
        F.slice(F.coalesce(c["evidence"], F.array().cast(cards.schema["card"].dataType["evidence"].dataType)), 1, 5),
        lambda e: F.concat(F.lit("- "), e["source_id"], F.lit(" (Observed: "), e["observed_at"], F.lit(")")),
    )
    countries = F.when(F.size(a["countries"]) > 0, F.array_join(a["countries"], ", ")).otherwise("None explicitly stated")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Evidence Card: "), h["canonical_name"]),
        F.lit(""), line("Organization", h["organization"]), line("Stage", h["stage"]), line("Stack", h["stack_family"]),
        F.lit(""), F.lit("### 1. Why Now"), line("Latest Signal", c["why_now"]["highlight"]), line("Total Evidence Count", c["why_now"]["recent_signals_count"]),
        F.lit(""), F.lit("### 2. Technical Identity"), line("CAIP-2", i["caip2"]), line("Chain ID", i["chain_id"]), line("Genesis Fingerprint", i["genesis_fingerprint"]),
        F.lit(""), F.lit("### 3. Regional Assessment"), line("Classification", a["label"]), line("Fit Score", a["score"]), line("Matched Countries", countries),
        F.lit(""), F.lit("### 4. Disclosed Capital"), line("Total USD", f["total_disclosed_usd"]), line("Rounds", f["rounds_count"]),
        F.lit(""), F.lit("### 5. Scoring"), line("Confidence", s["confidence"]), line("Momentum", s["momentum"]), line("Risk", s["risk"]),
        line("Radar Score", s["radar_score"]), line("Outreach Priority", s["outreach_score"]), line("Queue State", s["state"]),
        F.lit(""), F.lit("### 6. Recommended Next Action"), F.concat(F.lit("> "), c["recommendation"]),
        F.lit(""), F.lit("### 7. Primary Evidence Sources"), F.array_join(sources, "\n"),
    )
    return cards.select("candidate_id", text.alias("markdown"))


def digest(joined: DataFrame, limits: dict | None = None) -> DataFrame:
    """Candidates of a digest: the head of each state's queue with its position.

    ``joined`` are scored, funded candidates. Each head is a top-k, so nothing is sorted whole.
    """
    from winnow.functions.ordered import top_n

    limits = limits or DIGEST_LIMITS
    out = None
    for state, n in limits.items():
        part = top_n(joined.filter(F.col("state") == state), ["state"], queue_order(), n, rank="position")
        out = part if out is None else out.unionByName(part)
    return out


def digest_markdown(entries: DataFrame, title: str) -> DataFrame:
    """Digest as one line per listed candidate, in order (P6); header and sections are rows too."""
    head = entries.groupBy("state").agg(F.count("*").alias("n")).select(
        F.lit(0).alias("section"), F.col("state").alias("k"), F.lit(0).alias("position"),
        F.concat(F.lit(f"# {title} — "), "state", F.lit(": "), F.col("n").cast("string")).alias("line"),
    )
    order = F.when(F.col("state") == "HOT", 1).when(F.col("state") == "QUALIFIED", 2).otherwise(3)
    rows = entries.select(
        order.alias("section"), F.col("state").alias("k"), "position",
        F.concat(F.lit("- **"), "canonical_name", F.lit("** ("), "stack_family", F.lit(", "), F.coalesce("stage", F.lit("—")), F.lit("): Outreach "), F.round("outreach_score", 2).cast("string"), F.lit(" | "), F.coalesce("intent_label", F.lit(A4))).alias("line"),
    )
    return head.unionByName(rows).orderBy("section", "k", "position").select("section", "position", "line")
