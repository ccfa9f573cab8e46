"""Opportunity types in text and their records per candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Opportunity types in order, their terms and the suggested response.
OPPORTUNITIES = (
    ("community_operations", "community manager|moderator|chapter|local language|event organizer|contributor program",
     "Community-as-a-service proposal"),
    ("developer_relations", "devrel|developer relations|developer advocate|hackathon|sdk workshop|developer bootcamp",
     "Developer onboarding and university/hub program"),
    ("market_entry_bd", "country manager|regional lead|partnership|go-to-market|market entry|business development|exchange listing",
     "Country launch and partnership map"),
    ("ambassador_grants", "ambassador|ambassador program|ecosystem grants|rfp|bounty|grant cohort",
     "Operate or recruit an Africa cohort"),
    ("validator_infrastructure", "genesis validator|validator onboarding|node operator|rpc provider|indexer coverage|node latency",
     "Africa validator/RPC/infrastructure partnership"),
    ("adoption_user_acquisition", "merchant|payment gateway|mobile money|remittance|wallet integration|local rails|liquidity program",
     "Measured pilot with defined acquisition KPIs"),
    ("policy_enterprise", "government|central bank|telecom|regulator|enterprise pilot|public-sector",
     "Stakeholder engagement and compliant pilot"),
    ("investment_ma", "ecosystem fund|strategic investment|venture fund|formal acquisition",
     "Route to qualified advisory; never infer sale intent"),
)


def classify_opportunities(docs: DataFrame) -> DataFrame:
    """(doc_id, opportunity_type, response, matched) per type found, first match as text (C11).

    The eight patterns are literals of one projection, so text is read once and nothing is joined.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(kind).alias("opportunity_type"),
                F.lit(response).alias("response"),
                F.regexp_extract("text", f"(?i){_B}({terms}){_E}", 1).alias("matched"),
            )
            for kind, terms, response in OPPORTUNITIES
        ]
    )
    carry = [c for c in docs.columns if c != "text"]
    # Outer form: no inferred size filter that would run the patterns twice.
    return docs.select(*carry, F.inline_outer(F.filter(found, lambda x: x["matched"] != ""))).filter(F.col("matched").isNotNull())


def upsert_opportunities(matches: DataFrame) -> DataFrame:
    """One record per (candidate, type) with the summary of the first match.

    Evidence references stay rows (``opportunity_refs``); the record keeps their number.
    """
    order = F.struct("observed_at", "evidence_id")
    summary = F.concat("response", F.lit(" (matched: "), "matched", F.lit(")"))
    return matches.groupBy("candidate_id", "opportunity_type").agg(
        F.min_by(summary, order).alias("summary"),
        F.min("observed_at").alias("first_seen_at"),
        F.count_distinct("evidence_id").alias("n_evidence"),
    )


def opportunity_refs(matches: DataFrame) -> DataFrame:
    """Evidence rows behind each opportunity record."""
    return matches.groupBy("candidate_id", "opportunity_type", "evidence_id").agg(F.min("observed_at").alias("observed_at"))
