"""From raw items to the queue in one batch, in two, and again."""

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from winnow import batch as BA
from winnow.operators import assess as A
from winnow.operators import normalize as N
from winnow.operators import resolve as R
from winnow.sources.lexicon import default_lexicon

T0 = datetime(2026, 1, 5)
RAW = "source_id string, external_id string, observed_at timestamp, payload string, content_hash string, source_family string"
REGISTER = "source_id string, family string, tier string, retention_days int, kill_switch boolean"


def items(spark, rows):
    made = []
    for i, (source, family, day, payload) in rows:
        text = json.dumps(payload, sort_keys=True)
        made.append((source, f"{source}-{i}", T0 + timedelta(days=day), text, hashlib.sha256(text.encode()).hexdigest(), family))
    return spark.createDataFrame(made, RAW)


def pull(name, chain, words=""):
    return {"pr_number": chain, "title": f"Add {name} testnet (chainId: {chain})", "body": f"see https://rpc.{name.lower()}.example {words}", "created_at": "2026-01-02T00:00:00Z", "user": "u"}


def post(name, link, words):
    return {"title": f"Announcing {name} on a new stack", "summary": words, "link": link, "feed_name": "f"}


ROWS = list(
    enumerate(
        [
            ("ethereum_lists", "registry", 0, pull("Fennel", 8101, "A hackathon in Lagos, Nigeria opens the season.")),
            ("feed", "official_web", 1, post("Fennel", "https://fennel.example/a", "A community manager will start in Nigeria.")),
            ("ethereum_lists", "registry", 2, pull("Sorrel", 8102)),
            ("feed", "official_web", 3, post("Sorrel", "https://sorrel.example/b", "Plain words only.")),
            ("ethereum_lists", "registry", 4, pull("Chervil", 8101)),
            ("off", "social", 4, post("Hidden", "https://hidden.example", "x")),
            ("feed", "official_web", 5, post("Fennel", "https://fennel.example/c", "Developer grants for Kenya.")),
        ]
    )
)
JOBS = (lambda e: N.normalize_registry_prs(e.filter("source_id = 'ethereum_lists'")), lambda e: N.normalize_feed_entries(e.filter("source_id = 'feed'")))


def table(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_two_batches_equal_one_and_repeats_add_nothing(spark):
    register = spark.createDataFrame([("ethereum_lists", "registry", "A", 90, False), ("feed", "official_web", "A", 90, False), ("off", "social", "C", 90, True)], REGISTER)
    run = lambda rows, old=None: BA.run_batch(items(spark, rows), register, JOBS, default_lexicon(spark), "2026-01-12 00:00:00", old)
    whole, first = run(ROWS), run(ROWS[:3])
    second = run(ROWS[3:], first.state)
    assert whole.new_evidence.count() == 6 and second.new_evidence.count() == 3
    assert table(whole.state.observations, "evidence_id", "org_id", "candidate_id") == table(second.state.observations, "evidence_id", "org_id", "candidate_id")
    score = ("candidate_id", "state", F.round("confidence", 6), F.round("outreach_score", 6), "stage", "label")
    for name, cols in (("assessments", ("candidate_id", "intent_label", "total_score", "n_evidence")), ("tasks", ("task_type", "candidate_id", "related_candidate_id", "n_evidence")), ("signals", ("candidate_id", "signal_type")), ("snapshots", score)):
        assert table(getattr(whole, name), *cols) == table(getattr(second, name), *cols), name
    again = run(ROWS, second.state)
    assert again.new_evidence.count() == 0 and table(again.snapshots, *score) == table(second.snapshots, *score)
    collided = {r.candidate_id for r in whole.signals.filter("signal_type = 'chain_id_collision'").collect()}
    risky = {r.candidate_id for r in whole.candidates.filter("risk > 0 AND array_contains(risk_flags, 'chain identity contradicts itself or collides')").collect()}
    assert collided and collided == risky
    labels = {r.canonical_name: r.label for r in whole.candidates.collect()}
    assert any(v and v[:2] in ("A1", "A2") for k, v in labels.items() if "Fennel" in k)
    assert BA.ranked_queue(whole.snapshots, 2).count() == 2


def test_every_earlier_claimant_is_signalled(spark):
    rows = [("eip155:1", o, f"c{o}", T0 + timedelta(days=d), f"e{d}") for d, o in enumerate("abca")] + [("eip155:2", "a", "ca", T0, "e9"), (None, "z", "cz", T0, "e8")]
    claims = spark.createDataFrame(rows, "caip2 string, organization_id string, candidate_id string, observed_at timestamp, evidence_id string")
    assert {(r.candidate_id, r.evidence_id) for r in R.collision_signals(claims).collect()} == {("ca", "e2"), ("cb", "e2")}


def test_override_freezes_the_row(spark):
    cols = ", ".join(f"{c} double" for c in A.SUB_SCORES)
    n = len(A.SUB_SCORES)
    rows = [("x", T0, "e1", "A3_africa_compatible", 0.5, *[1.0] * n), ("x", T0 + timedelta(days=9), "e2", "A1_explicit_intent", 0.9, *[9.0] * n), ("y", T0 + timedelta(days=9), "e3", "A1_explicit_intent", 0.9, *[9.0] * n)]
    feats = spark.createDataFrame(rows, f"candidate_id string, observed_at timestamp, evidence_id string, label string, label_confidence double, {cols}")
    at = T0 + timedelta(days=3)
    over = spark.createDataFrame([("x", "o1", at, "A2_active_regional_motion", None), ("y", "o2", at, "A4_no_evidence", 7.0)], "candidate_id string, event_id string, at timestamp, intent_label string, manual_score double")
    got = {r.candidate_id: r for r in A.rollup_assessments(feats, over).collect()}
    x, y = got["x"], got["y"]
    assert (x.intent_label, x.confidence, x.total_score, x.n_evidence, x[A.SUB_SCORES[0]]) == ("A2_active_regional_motion", 0.5, float(n), 1, 1.0)
    assert (y.intent_label, y.confidence, y.total_score, y.n_evidence, y.overridden) == ("A4_no_evidence", 0.0, 7.0, 0, True)
    assert A.rollup_assessments(feats).filter("candidate_id = 'x'").first().intent_label == "A1_explicit_intent"
