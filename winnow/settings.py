"""Rule configuration: every threshold, weight, half-life and TTL as one immutable value."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


def _d(**kw):
    return field(default_factory=lambda: dict(kw))


@dataclass(frozen=True)
class Rules:
    # Score weights.
    radar_momentum: float = 0.40
    radar_confidence: float = 0.35
    radar_fit: float = 0.25
    outreach_confidence: float = 0.45
    outreach_fit: float = 0.35
    outreach_momentum: float = 0.20
    outreach_risk: float = 0.30
    # Outreach gate and state thresholds.
    gate_confidence_min: float = 65.0
    gate_min_families: int = 2
    hot_confidence_min: float = 75.0
    hot_outreach_min: float = 70.0
    hot_risk_max: float = 34.0
    qualified_confidence_min: float = 65.0
    qualified_outreach_min: float = 55.0
    radar_watch_min: float = 45.0
    # Freshness half-lives in days by source family.
    half_life_days: dict = _d(
        registry=21.0, official_web=14.0, code_search=10.0, infrastructure=21.0, careers=30.0,
        news=7.0, social=3.0, market=30.0, verification=7.0, standards=45.0, explorer=21.0,
        interop=21.0, default=14.0,
    )
    # Evidence time-to-live in days by lifecycle stage.
    stale_days: dict = _d(
        S0_research_hint=30, S1_devnet_prototype=45, S2_public_testnet=21,
        S3_incentivized_testnet=14, S4_mainnet_announced=14, S5_early_mainnet=21,
        S6_established_archived=90,
    )
    # Windows.
    early_mainnet_days: int = 180
    momentum_days: int = 14
    evidence_bucket_minutes: int = 60
    alert_dedup_hours: int = 24
    contact_inactivity_days: int = 90
    recheck_min_seconds: int = 60
    backfill_days: int = 14
    # Vitality.
    active_days: int = 30
    slowing_days: int = 90
    dormant_days: int = 180
    vitality_half_life_days: float = 45.0
    channel_weights: dict = _d(
        rpc=0.30, explorer=0.20, github=0.25, website=0.10, blog=0.05, x=0.04, farcaster=0.03,
        bluesky=0.02, discord=0.01, telegram=0.00,
    )
    # Funding bands and currencies taken at face value.
    strong_raise_usd: float = 15_000_000.0
    material_raise_usd: float = 2_000_000.0
    supported_currencies: tuple = ("USD",)
    # Outreach-fit component weights.
    fit_capacity: float = 0.22
    fit_timing: float = 0.20
    fit_relevance: float = 0.25
    fit_reach: float = 0.13
    fit_contact: float = 0.12
    fit_engineering: float = 0.08
    # Endpoint policy.
    allowed_schemes: tuple = ("https",)
    allow_http_hosts: tuple = ()
    allowed_ports: tuple = (80, 443, 8545, 8546, 26657, 9944, 8899, 9650, 4000)
    # Markets that reports always list.
    priority_markets: tuple = ("NG", "KE", "GH", "ZA", "RW", "EG", "MA", "UG", "TZ", "SN", "CI")
    require_evidence_for_explicit_intent: bool = True

    @property
    def version(self) -> str:
        """``v1.0+`` and 12 hex digits that change with any rule, stamped on every score."""
        text = json.dumps(asdict(self), sort_keys=True, default=str)
        return "v1.0+" + hashlib.sha256(text.encode()).hexdigest()[:12]


DEFAULT = Rules()
