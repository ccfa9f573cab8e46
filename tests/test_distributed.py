"""Distributed helpers against brute force on small frames."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from winnow.functions.ordered import MIDDLE, keep_first_per_gap, previous_by_range, values_at_ranks, with_next_mark, with_previous
from winnow.functions.text import chain_id, domain, normalize_name, redacted_url, stable_key
from winnow.operators import ledger as L
from winnow.operators import resolve as R

T0 = datetime(2024, 1, 1)
RAW = "source_id string, external_id string, content_hash string, observed_at timestamp"


def greedy(rows):
    ext, con, out = set(), set(), set()
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        bucket = int((r[3] - datetime(1970, 1, 1)).total_seconds()) // 3600
        a, b = (r[0], r[1]), (r[0], r[2], bucket)
        if a not in ext and b not in con:
            ext.add(a)
            con.add(b)
            out.add((r[0], r[1], r[2]))
    return out


def ledger(spark, rows, old=None):
    df = L.append_evidence(spark.createDataFrame(rows, RAW), old)
    return df


def test_ledger_readmits_after_content_rejection(spark):
    rows = [("s", "A", "h", T0), ("s", "B", "h", T0 + timedelta(seconds=1)), ("s", "B", "k", T0 + timedelta(seconds=2))]
    got = {(r.external_id, r.content_hash) for r in ledger(spark, rows).collect()}
    assert got == {("A", "h"), ("B", "k")}


def test_ledger_matches_sequential_order(spark):
    rnd = random.Random(7)
    rows = [
        (f"s{rnd.randrange(2)}", f"e{rnd.randrange(12)}", f"h{rnd.randrange(6)}", T0 + timedelta(seconds=i * 97))
        for i in range(120)
    ]
    rnd.shuffle(rows)
    first = ledger(spark, rows)
    assert {(r.source_id, r.external_id, r.content_hash) for r in first.collect()} == greedy(rows)
    # A replay of an accepted row, or of its content in its bucket, adds nothing.
    again = ledger(spark, [(r.source_id, r.external_id, r.content_hash, r.observed_at) for r in first.collect()], first)
    assert again.count() == 0


def test_ledger_content_in_later_bucket_is_new(spark):
    rows = [("s", "A", "h", T0), ("s", "B", "h", T0 + timedelta(seconds=30)), ("s", "C", "h", T0 + timedelta(hours=2))]
    assert {r.external_id for r in ledger(spark, rows).collect()} == {"A", "C"}


def test_previous_row_equals_lag(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), T0 + timedelta(minutes=rnd.randrange(6000)), i, rnd.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id int, v int")
    got = with_previous(df, ["k"], "at", ["id"], ["v"], slice_seconds=7200)
    want = df.withColumn("prev_v", F.lag("v").over(W.partitionBy("k").orderBy("at", "id")))
    assert sorted(map(tuple, got.select("id", "prev_v").collect())) == sorted(map(tuple, want.select("id", "prev_v").collect()))


def test_gap_thinning_equals_greedy(spark):
    rnd = random.Random(5)
    rows = sorted({(rnd.choice("xy"), T0 + timedelta(minutes=rnd.randrange(20000))) for _ in range(250)})
    df = spark.createDataFrame(rows, "k string, at timestamp")
    want, last = set(), {}
    for k, at in rows:
        if k not in last or at > last[k] + timedelta(hours=24):
            want.add((k, at))
            last[k] = at
    assert {tuple(r) for r in keep_first_per_gap(df, ["k"], "at", 86400).collect()} == want


def test_components_equal_union_find(spark):
    rnd = random.Random(11)
    edges = [(f"n{rnd.randrange(90)}", f"n{rnd.randrange(90)}") for _ in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        par[find(a)] = find(b)
    want = {}
    for x in list(par):
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in R.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect():
        got.setdefault(r.component, set()).add(r.node)
    lone = {a for a, b in edges if a == b}
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(v) for v in want.values() if len(v) > 1 or v - lone)


def test_scalar_helpers(spark):
    import uuid

    df = spark.createDataFrame(
        [("https://User:p@WWW.Foo.io:8545/a", "0xFF", "Côte  d'Ivoire,\tLABS!"), ("foo.io/x", "-007", "Ａｃｍｅ ﬁnance")], "u string, c string, n string"
    )
    rows = df.select(domain(F.col("u")), chain_id(F.col("c")), normalize_name(F.col("n"))).collect()
    assert tuple(rows[0]) == ("foo.io", "255", "côte d ivoire labs")
    assert tuple(rows[1]) == ("foo.io", "-7", "acme finance")
    u = "https://u:p@rpc.io/v2/ABCDEFGHIJKLMNOPQRSTUVWX/z?Token=1&a=2#f"
    row = spark.createDataFrame([(u,)], "u string").select(redacted_url(F.col("u")), stable_key(F.lit(" Org"), F.lit("X.io"))).first()
    assert row[0] == "https://<redacted>@rpc.io/v2/<redacted>/z?Token=<redacted>&a=2#f"
    assert row[1] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "org:x.io"))


def test_long_hex_chain_ids(spark):
    vals = ["0x" + "F" * n for n in (1, 16, 17, 24, 31)] + ["0x" + "1" * 40, "0x", "0x0010", "abc"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "c string").select(chain_id(F.col("c"))).collect()]
    assert got == [str(int(v, 16)) for v in vals[:5]] + [vals[5], "0x", "16", "abc"]


def test_previous_row_by_range_equals_lag(spark):
    rnd = random.Random(3)
    # One key holds nearly all rows, and all of them at one moment.
    rows = [(rnd.choice("aaaaaaaab"), T0, i, rnd.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = previous_by_range(df, ["k"], ["at", "id"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.withColumn("prev_v", F.lag("v").over(W.partitionBy("k").orderBy("at", "id")))
    assert sorted((r.id, r.prev_v or -1) for r in got) == sorted((r.id, r.prev_v or -1) for r in want.select("id", "prev_v").collect())


def test_values_at_ranks(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aaaab") if i % 50 else None, None if i % 9 == 0 else rnd.choice([1.5, 2.0, 7.25, rnd.random()])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r for r in values_at_ranks(df, ["k"], "v", **MIDDLE, p90=lambda n: F.floor(F.lit(0.9) * (n - 1))).collect()}
        whole = values_at_ranks(df, [], "v", **MIDDLE).first()
        none = values_at_ranks(df.filter("v < 0"), [], "v", **MIDDLE).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k in ("a", "b", None):
        vals = sorted(v for x, v in rows if x == k and v is not None)
        assert got[k].n == len(vals) and got[k]["_low"] == vals[(len(vals) - 1) // 2] and got[k]["_high"] == vals[len(vals) // 2] and got[k].p90 == vals[int(0.9 * (len(vals) - 1))]
    every = sorted(v for _, v in rows if v is not None)
    assert (whole["_low"] + whole["_high"]) / 2 == (every[(len(every) - 1) // 2] + every[len(every) // 2]) / 2
    assert [r.n for r in none] in ([], [None])


def test_next_mark(spark):
    rnd = random.Random(6)
    rows = [(i, T0 + timedelta(minutes=rnd.randrange(0, 3000, 5)), rnd.random() < 0.4) for i in range(2000)]
    marks = sorted({T0 + timedelta(minutes=rnd.randrange(0, 2500, 5)) for _ in range(40)})
    df = spark.createDataFrame(rows, "id int, _t timestamp, _late boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(m,) for m in marks], "m timestamp")
        got = {r.id: r["_mark"] for r in with_next_mark(df, table, ["id"], few=3).collect()}
        assert got == {r.id: r["_mark"] for r in with_next_mark(df, table, ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 2000
    for i, t, late in rows:
        assert got[i] == next((m for m in marks if (m > t if late else m >= t)), None)


def test_alternating_chain_takes_logarithmic_rounds(spark):
    """Each row conflicts with the one before it, by external id and by content in turn."""
    from winnow.functions.matching import first_come

    rows = [("s", f"e{(i + 1) // 2}", f"h{i // 2}", T0 + timedelta(milliseconds=i)) for i in range(1000)]
    table = spark.createDataFrame(rows, RAW)
    won, rounds = first_come(table, ["source_id", "external_id"], ["source_id", "content_hash"], ["observed_at"])
    assert rounds <= 12
    assert {(r.external_id, r.content_hash) for r in won.collect()} == {r[1:3] for r in rows[::2]}
    assert {(r.source_id, r.external_id, r.content_hash) for r in ledger(spark, rows).collect()} == greedy(rows)


def test_first_come_equals_greedy_on_dense_conflicts(spark):
    from winnow.functions.matching import first_come

    for seed in range(4):
        rnd = random.Random(seed)
        rows = [(f"a{rnd.randrange(3 + 12 * seed)}", f"b{rnd.randrange(4 + 9 * seed)}", i) for i in range(400)]
        taken, want = (set(), set()), set()
        for a, b, i in rows:
            if a not in taken[0] and b not in taken[1]:
                taken[0].add(a)
                taken[1].add(b)
                want.add(i)
        won, _ = first_come(spark.createDataFrame(rows, "a string, b string, i int").repartition(3), ["a"], ["b"], ["i"])
        assert {r.i for r in won.collect()} == want
    # Tails that no minimum decides: every second row is first in neither of its keys.
    rows = [(f"a{rnd.randrange(60)}", f"b{rnd.randrange(60)}", i) for i in range(300)]
    empty, rounds = first_come(spark.createDataFrame(rows, "a string, b string, i int").limit(0), ["a"], ["b"], ["i"])
    assert empty.count() == 0 and rounds == 0
