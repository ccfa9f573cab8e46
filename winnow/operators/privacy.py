"""Suppression and retention of contacts, alerts, and analyst decisions as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordered import keep_first_per_gap, top_n
from winnow.functions.text import channel_hash
from winnow.functions.timefn import age_days
from winnow.operators.queues import hot_transitions
from winnow.settings import DEFAULT, Rules

REDACTED = "[REDACTED-HASH-ONLY]"


def apply_suppressions(contacts: DataFrame, requests: DataFrame, value: str = "channel_value") -> DataFrame:
    """Contacts with opt-outs applied.

    A request without a matching contact leaves a record that holds only the hash.
    """
    c = contacts.withColumn("channel_hash", channel_hash(F.col(value)))
    r = requests.select(channel_hash(F.col(value)).alias("channel_hash"), F.lit(True).alias("_req")).distinct()
    return c.join(r, "channel_hash", "full").select(
        "channel_hash",
        *[F.col(x) for x in contacts.columns if x not in (value, "suppressed")],
        F.coalesce(F.col(value), F.lit(REDACTED)).alias(value),
        (F.coalesce("_req", F.lit(False)) | F.coalesce("suppressed", F.lit(False))).alias("suppressed"),
    )


def expire_contacts(contacts: DataFrame, as_of, rules: Rules = DEFAULT) -> DataFrame:
    """Contacts kept by retention: suppressed ones, and those verified within the period."""
    old = age_days(F.col("last_verified_at"), as_of) > rules.contact_inactivity_days
    return contacts.filter(F.col("suppressed") | ~F.coalesce(old, F.lit(False)))


def alert_dedup_key(transitions: DataFrame) -> DataFrame:
    """Key of an alert: candidate, state, stage, label and evidence count."""
    cols = ("candidate_id", "state", "stage", "label", "evidence_count")
    return transitions.withColumn("dedup_key", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def alert_log(transitions: DataFrame, at: str = "calculated_at", rules: Rules = DEFAULT) -> DataFrame:
    """Alerts to send (P3): per dedup key the first, then none for the dedup window after each sent.

    Rows already sent may be among ``transitions``; replaying them gives the same log.
    """
    one = top_n(transitions, ["dedup_key", at], [F.col("snapshot_id")])
    # An alert exactly at the end of the window is still a duplicate: strictly later counts.
    return keep_first_per_gap(one, ["dedup_key"], at, rules.alert_dedup_hours * 3600)


def alerts_from_history(snapshots: DataFrame, facts: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """W8 transitions with their facts, deduplicated by P3."""
    return alert_log(alert_dedup_key(hot_transitions(snapshots).join(facts, "candidate_id", "left")), rules=rules)


def apply_transitions(current: DataFrame, events: DataFrame) -> DataFrame:
    """Scores with the latest analyst workflow state."""
    last = events.groupBy("candidate_id").agg(F.max_by("workflow_state", F.struct("at", "event_id")).alias("_wf"))
    return current.join(last, "candidate_id", "left").withColumn("workflow_state", F.coalesce("_wf", "workflow_state")).drop("_wf")


def apply_overrides(assessments: DataFrame, events: DataFrame) -> DataFrame:
    """Assessments with the latest analyst override; an override without a score keeps it."""
    last = events.groupBy("candidate_id").agg(F.max_by(F.struct("intent_label", "manual_score"), F.struct("at", "event_id")).alias("_o"))
    return (
        assessments.join(last, "candidate_id", "left")
        .withColumn("overridden", F.col("_o").isNotNull())
        .withColumn("intent_label", F.coalesce("_o.intent_label", "intent_label"))
        .withColumn("total_score", F.coalesce("_o.manual_score", "total_score"))
        .drop("_o")
    )


def resolve_tasks(tasks: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks after resolution, rejected events) (P10): the first event resolves an open task, every
    other event on it, on a resolved task or on none is rejected."""
    first = top_n(events, ["task_id"], [F.col("at"), F.col("event_id")]).select(
        "task_id", F.col("event_id").alias("_e"), F.col("resolution").alias("_r"), F.col("actor").alias("_a"), F.col("at").alias("_at")
    )
    opened = F.col("status") == "open"
    done = (
        tasks.join(first, "task_id", "left")
        .withColumn("_hit", opened & F.col("_e").isNotNull())
        .select(
            *[F.col(c) for c in tasks.columns if c != "status"],
            F.when(F.col("_hit"), F.lit("resolved")).otherwise(F.col("status")).alias("status"),
            F.when(F.col("_hit"), F.col("_r")).alias("resolution"),
            F.when(F.col("_hit"), F.col("_a")).alias("resolved_by"),
            F.when(F.col("_hit"), F.col("_at")).alias("resolved_at"),
            F.when(F.col("_hit"), F.col("_e")).alias("resolved_by_event"),
        )
    )
    used = done.filter(F.col("resolved_by_event").isNotNull()).select(F.col("resolved_by_event").alias("event_id"))
    return done, events.join(used, "event_id", "left_anti")
