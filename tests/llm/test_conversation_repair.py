"""Repairs against plain search over whole edit strings, through one task and through many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from winnow.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """Rows (turn, role, text) in order -> first fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(rows, bad, audit):
    """Cost and turns of an edit string, or None where it breaks a rule."""
    cost, out, i = 0, [], 0
    for k, letter in enumerate(audit):
        if letter == "I":
            out.append(("?", ""))
            cost += 5
            continue
        fault, (_, role, text) = bad[i], rows[i]
        i += 1
        if letter == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 5 * (fault == "truncated") + (letter == "R")
        out.append((role if letter == "K" else "?", text))
    named = []
    shift = 1 if out and out[0][0][:1] == "s" else 0
    for k, (role, text) in enumerate(out):
        want = ("user", "assistant")[(k - shift) % 2] if k >= shift else role
        if role != "?" and k >= shift and role[:1] != want[:1]:
            return None
        named.append((want if role == "?" else role, text))
    return (cost, named) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in named)) else None


def exhaustive(rows):
    bad, best = faults(rows), None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(inserts) <= 3:
                audit = "".join("I" * n + x for n, x in zip(inserts, letters)) + "I" * inserts[-1]
                got = apply(rows, bad, audit)
                if got and (best is None or (got[0], audit) < best):
                    best = (got[0], audit)
    return best


def plain(rows):
    """The least (cost, edit string) of each state row by row, with whole strings."""
    names = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}

    def insert(best):
        for _ in range(2):
            for state, (cost, text) in list(best.items()):
                to = names[state][1]
                best[to] = min(best.get(to, (cost + 5, text + "I")), (cost + 5, text + "I"))
        return best

    best = {0: (0, "")}
    for fault, (_, role, _) in zip(faults(rows), rows):
        found = {}
        for state, (cost, text) in best.items():
            found.setdefault(state, []).append((cost + 2, text + "D"))
        for state, (cost, text) in insert(best).items() if fault not in ("blank", "duplicate") else ():
            cost += 5 * (fault == "truncated")
            want, to = names[state]
            found.setdefault(to, []).append((cost + 1, text + "R"))
            if role[:1] == want:
                found.setdefault(to, []).append((cost, text + "K"))
            if role[:1] == "s" and state == 0:
                found.setdefault(1, []).append((cost, text + "K"))
        best = {state: min(ways) for state, ways in found.items()}
    return min(insert(best)[s] for s in (0, 3) if s in best)


def expected(rows):
    bad = faults(rows)
    cost, audit = plain(rows)
    again, turns = apply(rows, bad, audit)
    assert again == cost
    seen = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(seen) - min(seen) + 1 - len(set(seen)) if seen else 0, **{f: bad.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    }


def turns(r, n, roles=("user", "assistant", "system", "tool", " ")):
    pool = ["Yes.", "No.", "Why?", "", " \n", "cut", "Fine! ", "end .\t", "Über…"]
    weights = [8, 8] + [1] * (len(roles) - 2)
    return [(k, r.choices(roles, weights)[0], r.choice(pool) if r.random() < 0.4 else f"t{r.randrange(10**6)}.") for k in range(n)]


def order(rows):
    digest = lambda x: hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, digest(x)))


def test_plain_search_against_all_edit_strings():
    r = random.Random(1)
    for _ in range(60):
        rows = turns(r, r.randint(0, 4))
        assert plain(rows) == exhaustive(rows), rows


def test_survivors_against_plain_search():
    r = random.Random(2)
    for k in range(600):
        rows = turns(r, r.randint(0, 40), ("user", "assistant", "system", "tool") if k % 3 else ("tool", "user"))
        got = C.repair_rows({"turn": t, "role": a, "text": x, "fault": f} for f, (t, a, x) in zip(faults(rows), rows))
        assert (got["cost"], got["audit"]) == plain(rows), rows


def test_memory_follows_the_unresolved_rows():
    best, peak, emitted = C.Survivors(), 0, 0
    for k in range(20000):
        emitted += len(best.push("", "ua"[k % 2]))
        peak = max(peak, best.held)
    assert peak < 40 and emitted > 19900


@pytest.mark.parametrize("seed", range(3))
def test_parts_against_plain_search(seed):
    r = random.Random(seed)
    for _ in range(100):
        rows = turns(r, r.randint(2, 30), ("user", "assistant", "system", "tool") if seed else ("tool", "assistant"))
        bad, parts, cuts = faults(rows), [], sorted(r.sample(range(1, len(rows)), r.randint(1, min(4, len(rows) - 1))))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            tally, ways = C.Tally(), [C.Survivors(s) for s in range(4)]
            costs, orders = [None] * 16, [None] * 16
            for f, (t, role, _) in zip(bad[a:b], rows[a:b]):
                tally.add(f, t, role[:1])
                for w in ways:
                    w.push(f, role[:1])
            for s, w in enumerate(ways):
                for place, (to, cost, _) in enumerate(w.best):
                    costs[4 * s + to], orders[4 * s + to] = cost, place
            row = {c: getattr(tally, c) for c in ("first_turn", "last_turn", "turns", "first_role", "last_role")} | tally.n
            parts.append({"conv_id": 1, "part": k, "costs": costs, "orders": orders, "a": a, "b": b} | row)
        chained, audit = C.chain_parts(parts)[::-1], ""
        for p, c in zip(parts, chained):
            best, writer = C.Survivors(c["enter"]), C.Writer(c["enter"])
            for f, (_, role, text) in zip(bad[p["a"] : p["b"]], rows[p["a"] : p["b"]]):
                writer.rows.append((role, text))
                writer.take(best.push(f, role[:1]))
            writer.take(best.finish(None if c["ends"] else c["leave"])[1])
            audit += "".join(writer.audit)
        want = expected(rows)
        assert audit == want["audit"] and {x: chained[-1][x] for x in C.COUNTS} == {x: want[x] for x in C.COUNTS}


def compare(spark, tables):
    """``tables``: conv_id -> rows (turn, role, text), nulls as they are."""
    flat = [(c, *row) for c, rows in tables.items() for row in rows]
    random.Random(0).shuffle(flat)
    out = {r.conv_id: r.asDict() for r in C.digests(C.repair(spark.createDataFrame(flat, SCHEMA).repartition(7))).collect()}
    assert set(out) == {c for c, rows in tables.items() if rows}
    for c, rows in tables.items():
        if rows:
            want = expected(order([(t, " " if a is None else a, " " if x is None else x) for t, a, x in rows]))
            assert {k: out[c][k] for k in want} == want, c


def test_many_short_conversations(spark):
    r = random.Random(3)
    tables = {c: turns(r, r.randint(1, 9)) for c in range(300)}
    tables[None] = [(0, "user", "Hi."), (1, None, None), (None, "assistant", "Yes."), (None, "user", None)]
    tables[-5] = [(2, "user", "Same.")] * 4 + [(None, "assistant", "Ok.")] * 2
    tables[-6] = [(None, None, None)]
    compare(spark, tables)


def test_long_conversations_over_many_tasks(spark):
    r = random.Random(4)
    tables = {1: turns(r, 3), 2: turns(r, 5000), 3: turns(r, 4), 4: [(k // 3, "tool", f"x{k}.") for k in range(2500)], 5: [(7, "user", "Same.")] * 4000, 6: turns(r, 2), None: turns(r, 2100)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        compare(spark, tables)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_query_damages_and_repairs(spark):
    r = random.Random(6)
    flat = [(c, *row) for c in range(400) for row in turns(r, r.randint(1, 6), ("user", "assistant", "system"))]
    table = spark.createDataFrame(flat, SCHEMA)
    rows = {c: [] for c in range(400)}
    for c, turn, role, text in flat:
        kind = zlib.crc32(f"{c}:{turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            rows[c] += [row] * (2 if kind == 3 else 1)
    assert any(not x for x in rows.values())
    out = {x.conv_id: x.asDict() for x in C.with_lost(C.digests(C.repair(C.damaged(table))), table).collect()}
    assert len(out) == 400
    for c, mine in rows.items():
        want = expected(order(mine))
        assert {k: out[c][k] for k in want} == want


def test_repaired_turns_and_odd_tables(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Well."), (1, 2, "tool", "x"), (2, 0, "user", "No")], SCHEMA)
    wide = table.selectExpr("*", "1 AS part", "'x' AS digest", "2 AS fault", "3 AS audit", "4 AS kind", "5 AS col")
    chunks = C.repair(wide)
    got = [(t.conv_id, t.role, t.text) for t in C.repaired_turns(chunks).orderBy("conv_id", "part", "chunk", "position").collect()]
    assert got == [(1, "user", "Hi."), (1, "assistant", "Well.")]
    none = spark.createDataFrame([], SCHEMA)
    assert C.with_lost(C.digests(C.repair(C.damaged(none))), none).count() == 0
    big = spark.createDataFrame([(1, 0, "user", "w " * 3_000_000 + "."), (1, 1, "assistant", "Ok.")], SCHEMA)
    assert C.digests(C.repair(big)).first().audit == "KK"
