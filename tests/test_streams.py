"""Streams in event time against their batch twins, on shuffled input over several triggers."""

import random
from datetime import datetime, timedelta

import pytest

from winnow.streaming.ingest import stream_buckets
from winnow.streaming.state import stream_alerts, stream_liveness, use_rocksdb

START = datetime(2026, 1, 1)
SCHEMAS = {
    "alerts": "dedup_key string, at timestamp",
    "probes": "endpoint_hash string, probe_id long, observed_at timestamp, success boolean, block_height long, identity_fingerprint string",
    "items": "source_id string, content_hash string, observed_at timestamp",
}


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs one trigger for each list of rows and gives all that left the stream."""
    use_rocksdb(spark)

    def run(kind, triggers, build):
        folder = str(tmp_path / kind)
        for rows in triggers:
            spark.createDataFrame(rows, SCHEMAS[kind]).coalesce(1).write.mode("append").parquet(folder)
            stream = build(spark.readStream.schema(SCHEMAS[kind]).parquet(folder))
            q = stream.writeStream.option("checkpointLocation", f"{folder}-cp").trigger(availableNow=True)
            q.format("parquet").option("path", f"{folder}-out").outputMode("append").start().awaitTermination()
        return spark.read.parquet(f"{folder}-out")

    return run


def shuffled(rows, seed, parts=2):
    random.Random(seed).shuffle(rows)
    return [rows[i::parts] for i in range(parts)]


def test_alerts_in_time_whatever_the_trigger(spark, streamed, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(4)}", at(rng.randrange(3600))) for _ in range(120)] + [("k0", at(7)), ("k0", at(7)), (None, at(5))]
    end, late = [("end", at(90_000))], [("k1", at(10)), ("k9", at(20)), ("end", None)]
    got = streamed("alerts", [*shuffled(list(rows), 5), end, late, [("last", at(200_000))], [("last", at(200_001))]], lambda s: stream_alerts(s, 600, "2 hours"))
    want, last = [], {}
    for key, t in sorted([*rows, *end], key=lambda r: r[1]):
        if key not in last or (t - last[key]).total_seconds() > 600:
            want.append((key or "", t))
            last[key] = t
    # The late rows are dropped; the last alert still waits.
    assert sorted((r.dedup_key or "", r.sent_at) for r in got.collect()) == sorted(want)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "alerts-cp"))
    assert state("last_sent").count() == 0, "keys leave after their window"


def test_liveness_equals_the_order_of_time(spark, streamed):
    rng = random.Random(4)
    height, rows = 0, []
    for i in range(80):
        height += rng.randrange(3)
        rows.append((f"e{i % 2}", i, START + timedelta(seconds=i // 3), rng.random() < 0.9, None if rng.random() < 0.1 else height, rng.choice(["a", "a", "b", None])))
    want, prev = {}, {}
    for e, i, at, ok, h, mark in sorted(rows, key=lambda r: (r[2], r[1])):
        p = prev.get(e)
        want[i] = bool(p and p[0] and ok and h is not None and p[1] is not None and h > p[1] and mark and mark == p[2])
        prev[e] = (ok, h, mark)
    end = [("end", 1000, START + timedelta(days=1), True, 1, "a")]
    got = streamed("probes", [*shuffled(rows, 6), end], lambda s: stream_liveness(s, "1 hour"))
    assert {r.probe_id: r.live for r in got.collect()} == want
    assert any(want.values())


def test_distinct_contents_are_exact(spark, streamed):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(2)}", rng.choice([*"abcdef", None]), START + timedelta(minutes=rng.randrange(180))) for _ in range(100)]
    end = [("end", "z", START + timedelta(days=d)) for d in (1, 2)]
    got = streamed("items", [*shuffled(list(rows), 8), end[:1], end[1:]], lambda s: stream_buckets(s, 60, "4 hours", contents=True))
    want = {}
    for s, c, at in rows:
        n, seen = want.get((s, at.hour), (0, set()))
        want[(s, at.hour)] = (n + 1, seen | {c} - {None})
    found = {(r.source_id, r.window.start.hour): (r.n, r.contents) for r in got.filter("source_id <> 'end'").collect()}
    assert found == {k: (n, len(s)) for k, (n, s) in want.items()}
