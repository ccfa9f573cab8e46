"""Stateful stream operators: alert dedup and liveness.

Both need the RocksDB state store, which ``use_rocksdb`` selects. Without a ``lateness`` rows count in the order of the triggers
that bring them. With one, rows wait in state until the watermark has passed them; an event-time timer for each millisecond
then takes them in order, whatever trigger brought them, and rows behind the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class AlertDedup(StatefulProcessor):
    """Lets an alert pass unless one with its key passed within the window. One timestamp is kept for each key."""

    def __init__(self, window_seconds: int = 86400) -> None:
        self.window = window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_sent", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times = np.unique(np.concatenate([pdf["at"].to_numpy() for pdf in rows]))  # eight bytes a row, nothing else is held
        sent = []
        for at in map(pd.Timestamp, times):
            if last is None or (at - pd.Timestamp(last)).total_seconds() > self.window:
                sent.append(at)
                last = at
        if sent:
            self.last.update((pd.Timestamp(last).to_pydatetime(),))
        yield pd.DataFrame({"dedup_key": [key[0]] * len(sent), "sent_at": pd.Series(sent, dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


class ProbeLiveness(StatefulProcessor):
    """Compares each probe with the one before it on the same endpoint."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("previous", "success boolean, height long, fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prev = tuple(self.prev.get()) if self.prev.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["observed_at", "probe_id"])
        ids, live = [], []
        for p in pdf.itertuples():
            height = None if pd.isna(p.block_height) else int(p.block_height)
            mark = None if pd.isna(p.identity_fingerprint) else p.identity_fingerprint
            ok = prev is not None and bool(prev[0]) and bool(p.success) and height is not None and prev[1] is not None
            ids.append(p.probe_id)
            live.append(bool(ok and height > prev[1] and mark and mark == prev[2]))
            prev = (bool(p.success), height, mark)
        self.prev.update(prev)
        yield pd.DataFrame({"endpoint_hash": [key[0]] * len(ids), "probe_id": ids, "live": live})

    def close(self) -> None:
        pass


class OrderedAlertDedup(StatefulProcessor):
    """``AlertDedup`` in order of event time. A key leaves the state when the window after its last alert has passed; a timer set
    while timers run out fires in the next trigger.

    A window is a millisecond at least, so of the alerts of one millisecond only the first can pass and is kept.
    """

    def __init__(self, window_seconds: int = 86400) -> None:
        self.window = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_sent", "us long")
        self.pending = handle.getMapState("pending", "ms long", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            us = np.sort(pdf["us"].to_numpy(np.int64))
            ms, at = np.unique(us // 1000, return_index=True)
            for m, u in zip(ms.tolist(), us[at].tolist()):
                if not self.pending.containsKey((m,)):
                    self.handle.registerTimer(m)
                elif self.pending.getValue((m,))[0] <= u:
                    continue
                self.pending.updateValue((m,), (u,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        if self.pending.containsKey((m,)):
            us = self.pending.getValue((m,))[0]
            self.pending.removeKey((m,))
            if last is None or us - last > self.window:
                self.last.update((us,))
                # The first millisecond in which the next alert passes whatever is known of this one.
                self.handle.registerTimer((us + self.window) // 1000 + 1)
                yield pd.DataFrame({"dedup_key": [key[0]], "us": [us]})
        elif last is not None and m * 1000 > last + self.window:
            self.last.clear()

    def close(self) -> None:
        pass


class OrderedProbeLiveness(StatefulProcessor):
    """``ProbeLiveness`` in order of event time: the probes that wait lie in a map by millisecond, so each step holds those of one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prev = handle.getValueState("previous", "success boolean, height long, fingerprint string")
        self.pending = handle.getMapState("pending", "ms long", "probes string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for m, part in pdf.groupby(pdf["us"] // 1000):
                m = int(m)
                known = json.loads(self.pending.getValue((m,))[0]) if self.pending.containsKey((m,)) else []
                if not known:
                    self.handle.registerTimer(m)
                for p in part.itertuples():
                    height = None if pd.isna(p.block_height) else int(p.block_height)
                    mark = None if pd.isna(p.identity_fingerprint) else p.identity_fingerprint
                    known.append((int(p.us), int(p.probe_id), not pd.isna(p.success) and bool(p.success), height, mark))
                self.pending.updateValue((m,), (json.dumps(known),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = expiredTimerInfo.getExpiryTimeInMs()
        if not self.pending.containsKey((m,)):
            return
        due = sorted(json.loads(self.pending.getValue((m,))[0]), key=lambda p: p[:2])
        self.pending.removeKey((m,))
        prev = tuple(self.prev.get()) if self.prev.exists() else None
        live = []
        for _, _, success, height, mark in due:
            rises = prev is not None and prev[0] and success and height is not None and prev[1] is not None and height > prev[1]
            live.append(bool(rises and mark and mark == prev[2]))
            prev = (success, height, mark)
        self.prev.update(prev)
        yield pd.DataFrame({"endpoint_hash": [key[0]] * len(due), "probe_id": [p[1] for p in due], "live": live})

    def close(self) -> None:
        pass


def stream_alerts(transitions: DataFrame, window_seconds: int = 86400, lateness: str | None = None) -> DataFrame:
    """Alerts to send from a stream of (dedup_key, at) (T5).

    ``lateness`` says how long to wait for alerts that come out of order; the result is then that of ``keep_first_per_gap`` over
    all alerts in time. Rows without ``at`` have no place in that order and are left out of it.
    """
    if lateness is None:
        return transitions.select("dedup_key", "at").groupBy("dedup_key").transformWithStateInPandas(
            AlertDedup(window_seconds), "dedup_key string, sent_at timestamp", "Append", "None"
        )
    rows = transitions.select("dedup_key", "at", F.unix_micros("at").alias("us")).filter("at IS NOT NULL").withWatermark("at", lateness)
    out = rows.groupBy("dedup_key").transformWithStateInPandas(OrderedAlertDedup(window_seconds), "dedup_key string, us long", "Append", "EventTime")
    return out.select("dedup_key", F.timestamp_micros("us").alias("sent_at"))


def stream_liveness(probes: DataFrame, lateness: str | None = None) -> DataFrame:
    """Verdict per probe against its predecessor from a stream of probes.

    ``lateness`` says how long to wait for probes that come out of order; each verdict is then final and the same as the batch's.
    """
    cols = ["endpoint_hash", "probe_id", "observed_at", "success", "block_height", "identity_fingerprint"]
    schema = "endpoint_hash string, probe_id long, live boolean"
    if lateness is None:
        return probes.select(*cols).groupBy("endpoint_hash").transformWithStateInPandas(ProbeLiveness(), schema, "Append", "None")
    rows = probes.select(*cols, F.unix_micros("observed_at").alias("us")).filter("observed_at IS NOT NULL").withWatermark("observed_at", lateness)
    return rows.groupBy("endpoint_hash").transformWithStateInPandas(OrderedProbeLiveness(), schema, "Append", "EventTime")
