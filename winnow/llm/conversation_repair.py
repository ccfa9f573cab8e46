"""Cheapest repair of the turn structure of conversations.

Kept, reroled, deleted and inserted turns must leave roles that read ``(s?(ua)+)?`` by their initials. A Viterbi search over the four
states of that pattern finds the cheapest edits, and the ASCII-least edit string among the cheapest. Its back pointers form a tree
whose nodes count their references: a node without any is freed, and once all survivors share an ancestor, the edits up
to it are final and leave memory. Survivors that another one can always undercut are given up, which lets the others meet.
A tie is decided by the complete edit strings: all survivors have edited the same rows and end in a row's edit, so
none is a prefix of another one, and their order follows from the order of their predecessors, then the last edit. This
order is kept with the survivors, so that a tie costs one comparison however long the unresolved strings are.

Rows are dealt by range over (conversation, turn), so one conversation may spread over many tasks. A conversation inside one
task is repaired there. A long one, or one at the border of a task, is repaired by parts: each part reports, for every state
before it, the cost and the order of the states after it; chaining these small reports gives the states at the borders, and each part is then edited between them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.store import saved

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the next turn of a user or an assistant.
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Inserted turns that end a conversation, by state.
ENDING = (0, 2, 1, 0)
#: What it costs at most to go on from the state of the row like the state of the column does.
UNDERCUT = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
#: A conversation of more rows or characters is repaired by parts.
PART_ROWS, PART_CHARS = 2000, 4_000_000

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Types by their names in Spark.
TYPES = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
    "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
}
_COUNTS = " ".join(f"{c} long" for c in COUNTS)
_RESULT = f"{_COUNTS} audit string repaired array<struct<role:string,text:string>>"
#: What a task returns: repaired conversations (part is null), or rows of those that are repaired by parts.
SCAN = f"conv_id long part long k long turn long role string text string digest string fault string {_RESULT}"
PART = (
    "conv_id long part long first_turn long last_turn long turns long first_role string last_role string "
    "blank long duplicate long truncated long illegal long costs array<long> orders array<long>"
)
PATH = f"conv_id long part long enter int leave int ends boolean {_COUNTS}"
CHUNK = f"conv_id long part long chunk long {_RESULT}"
DIGEST = f"conv_id long {_COUNTS} audit string repaired_sha256 string"


def _fields(schema: str) -> list[tuple[str, str]]:
    words = schema.split()
    return list(zip(words[::2], words[1::2]))


def ddl(schema: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in _fields(schema))


def _moves(initial: str, truncated: bool) -> list[list[tuple[int, str, int]]]:
    """By state: the cheapest (state after, edit, cost) of a row. An insertion before a deletion is never least: behind it, it costs the same."""
    out = []
    for state in range(4):
        best = {state: (DELETE, "D")}
        for at, before, price in ((state, "", 0), (FOLLOWS[state], "I", INSERT)):
            to = FOLLOWS[at]
            price += CUT * truncated
            ways = [(to, price + REROLE, before + "R")]
            if initial == NAMES[to][0]:
                ways.append((to, price, before + "K"))
            if initial == "s" and at == START:
                ways.append((SYSTEM, price, before + "K"))
            for to, cost, edit in ways:
                best[to] = min(best.get(to, (cost, edit)), (cost, edit))
        out.append([(to, edit, cost) for to, (cost, edit) in best.items()])
    return out


MOVES = {(i, t): _moves(i, t) for i in ("s", "u", "a", "") for t in (False, True)}
FORCED = [[(state, "D", DELETE)] for state in range(4)]


class Node:
    """An edit of a row; its references are its children and its being a survivor."""

    __slots__ = ("edit", "parent", "children", "survives")

    def __init__(self, edit: str, parent: Node | None):
        self.edit, self.parent, self.children, self.survives = edit, parent, [], True


class Survivors:
    """The best edits up to a row for each state, from one state before the first row."""

    def __init__(self, state: int = START):
        self.root = Node("", None)
        self.held = 1
        #: (state, cost, node), least edit string first.
        self.best = [(state, 0, self.root)]

    def push(self, fault: str, initial: str) -> list[str]:
        """Take the next row; returns the edits that have become final."""
        if fault in ("blank", "duplicate"):
            moves = FORCED
        else:
            moves = MOVES[initial if initial in ("s", "u", "a") else "", fault == "truncated"]
        found: dict[int, tuple[int, int, str, Node]] = {}
        for order, (state, cost, node) in enumerate(self.best):
            for to, edit, price in moves[state]:
                if to not in found or cost + price < found[to][0]:
                    found[to] = (cost + price, order, edit, node)
        worth = [to for to, f in found.items() if all(g[0] + UNDERCUT[x][to] >= f[0] for x, g in found.items())]
        old, self.best = self.best, []
        for to in sorted(worth, key=lambda x: found[x][1:3]):
            cost, _, edit, parent = found[to]
            node = Node(edit, parent)
            parent.children.append(node)
            self.held += 1
            self.best.append((to, cost, node))
        for _, _, node in old:
            node.survives = False
            while not node.children and not node.survives and node.parent is not None:
                node.parent.children.remove(node)
                node.parent, node = None, node.parent
                self.held -= 1
        final = []
        while len(self.root.children) == 1 and not self.root.survives:
            self.root = self.root.children[0]
            self.root.parent = None
            self.held -= 1
            final.append(self.root.edit)
        return final

    def finish(self, leave: int | None = None) -> tuple[int, list[str]]:
        """Cost and remaining edits, up to the end of the conversation or to the state ``leave`` at the end of a part."""
        if leave is None:
            cost, _, node, state = min((c + INSERT * ENDING[s], k, n, s) for k, (s, c, n) in enumerate(self.best))
            ending = ["I" * ENDING[state]]
        else:
            cost, node = next((c, n) for s, c, n in self.best if s == leave)
            ending = []
        edits = []
        while node is not self.root:
            edits.append(node.edit)
            node = node.parent
        return cost, edits[::-1] + ending


class Writer:
    """Applies edits to the rows that wait for them."""

    def __init__(self, state: int = START):
        self.state = state
        self.rows: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.turns: list[dict] = []

    def take(self, edits: list[str]) -> None:
        for letter in "".join(edits):
            role, text = ("", "") if letter == "I" else self.rows.popleft()
            self.audit.append(letter)
            if letter == "D":
                continue
            keeps_system = letter == "K" and self.state == START and role[:1] == "s"
            self.state = SYSTEM if keeps_system else FOLLOWS[self.state]
            self.turns.append({"role": role if letter == "K" else NAMES[self.state], "text": text})

    def flush(self) -> dict:
        out = {"audit": "".join(self.audit), "repaired": self.turns}
        self.audit, self.turns = [], []
        return out


class Tally:
    """Counts of a conversation or a part."""

    def __init__(self):
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.first_role = self.last_role = None

    def add(self, fault: str, turn: int | None, initial: str) -> None:
        if fault:
            self.n[fault] += 1
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in LEGAL:
            self.n["illegal"] += 1
        self.last_role = initial
        self.add_turns(turn, turn, 1)

    def add_turns(self, first: int | None, last: int | None, turns: int) -> None:
        if first is not None:
            self.turns += turns - (first == self.last_turn)
            self.first_turn = first if self.first_turn is None else self.first_turn
            self.last_turn = last

    def add_part(self, p: dict) -> None:
        for c in self.n:
            self.n[c] += p[c]
        self.n["illegal"] += self.last_role is not None and self.last_role + p["first_role"] not in LEGAL
        self.last_role = p["last_role"]
        self.add_turns(p["first_turn"], p["last_turn"], p["turns"])

    def counts(self, cost: int) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"gaps": gaps, **self.n, "cost": cost}


def text_fault(text: str) -> str:
    """The fault of a row by itself; that of an earlier copy comes between the two."""
    ending = text.rstrip(SPACE)[-1:]
    return "blank" if not ending else "" if ending in ".!?" else "truncated"


def repair_rows(rows: Iterable[dict]) -> dict:
    """Counts, audit and turns of one whole conversation, whose rows have ``fault``."""
    best, writer, tally = Survivors(), Writer(), Tally()
    for r in rows:
        initial = r["role"][:1]
        tally.add(r["fault"], r["turn"], initial)
        writer.rows.append((r["role"], r["text"]))
        writer.take(best.push(r["fault"], initial))
    cost, edits = best.finish()
    writer.take(edits)
    return tally.counts(cost) | writer.flush()


class Sender:
    """Gathers rows into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= 5000 or self.size >= PART_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in _fields(schema)])


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        # Some rows at a time: a list of all would hold the batch twice.
        for start in range(0, batch.num_rows, 500):
            yield from batch.slice(start, 500).to_pylist()


def _runs(records: Iterable[dict], key: Callable[[dict], tuple]) -> Iterator[tuple[bool, dict]]:
    """Each record, and whether its key is not that of the record before."""
    last = None
    for r in records:
        now = key(r)
        yield now != last, r
        last = now


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair the conversations that begin and end inside this task, and number the rows of the others."""
    part, out = TaskContext.get().partitionId(), Sender(_arrow(SCAN))
    held: list[dict] = []
    chars, whole, count = 0, False, 0

    def leave_to_parts() -> Iterator[pa.RecordBatch]:
        for r in held:
            yield from out.add(r | {"part": part}, len(r["text"]))
        held.clear()

    seen_first = False
    for new, r in _runs(_records(batches), lambda r: (r["conv_id"],)):
        if new:
            if whole:
                seen: set[str] = set()
                for h in held:
                    if h["fault"] != "blank" and h["digest"] in seen:
                        h["fault"] = "duplicate"
                    seen.add(h["digest"])
                yield from out.add({"conv_id": held[0]["conv_id"]} | repair_rows(held), chars)
                held.clear()
            else:
                yield from leave_to_parts()
            # The first one may have begun in the task before.
            whole, seen_first, chars = seen_first, True, 0
        held.append(r | {"k": count, "fault": text_fault(r["text"])})
        count, chars = count + 1, chars + len(r["text"])
        whole = whole and len(held) <= PART_ROWS and chars <= PART_CHARS
        if not whole and (len(held) > PART_ROWS or chars > PART_CHARS):
            yield from leave_to_parts()
            chars = 0
    # The last one may go on in the task after.
    yield from leave_to_parts()
    yield from out.rest()


def report_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part its counts, and costs and orders of the states after it (by state before, then after)."""
    out = Sender(_arrow(PART))
    now: dict | None = None

    def report() -> Iterator[pa.RecordBatch]:
        if now is not None:
            costs: list[int | None] = [None] * 16
            orders: list[int | None] = [None] * 16
            for enter, best in enumerate(now["ways"]):
                for order, (state, cost, _) in enumerate(best.best):
                    costs[4 * enter + state], orders[4 * enter + state] = cost, order
            t = now["tally"]
            row = {c: getattr(t, c) for c in ("first_turn", "last_turn", "turns", "first_role", "last_role")} | t.n
            yield from out.add({"conv_id": now["conv_id"], "part": now["part"], "costs": costs, "orders": orders} | row, 300)

    for new, r in _runs(_records(batches), lambda r: (r["conv_id"], r["part"])):
        if new:
            yield from report()
            now = {"conv_id": r["conv_id"], "part": r["part"], "tally": Tally(), "ways": [Survivors(s) for s in range(4)]}
        now["tally"].add(r["fault"], r["turn"], r["initial"])
        for best in now["ways"]:
            best.push(r["fault"], r["initial"])
    yield from report()
    yield from out.rest()


def chain_parts(parts: list[dict]) -> list[dict]:
    """The states at the borders of the parts of one conversation, and its counts."""
    tally = Tally()
    best = {START: (0, 0)}  # state -> (cost, order)
    back: list[dict[int, int]] = []
    for p in parts:
        tally.add_part(p)
        found: dict[int, tuple[int, int, int, int]] = {}
        for state, (cost, order) in best.items():
            for to in range(4):
                price = p["costs"][4 * state + to]
                if price is not None:
                    way = (cost + price, order, p["orders"][4 * state + to], state)
                    found[to] = min(found.get(to, way), way)
        places = sorted(found, key=lambda to: found[to][1:3])
        best = {to: (found[to][0], k) for k, to in enumerate(places)}
        back.append({to: f[3] for to, f in found.items()})
    cost, _, state = min((c + INSERT * ENDING[s], order, s) for s, (c, order) in best.items())
    counts, out = tally.counts(cost), []
    for k in range(len(parts) - 1, -1, -1):
        leave, state = state, back[k][state]
        last = k == len(parts) - 1
        out.append({"conv_id": parts[k]["conv_id"], "part": parts[k]["part"], "enter": state, "leave": leave, "ends": last} | (counts if last else {}))
    return out


def find_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chain_parts`` for each conversation; there is at most one part for each conversation and task of the scan."""
    out = Sender(_arrow(PATH))
    parts: list[dict] = []
    for new, r in _runs(_records(batches), lambda r: (r["conv_id"],)):
        if new and parts:
            for row in chain_parts(parts):
                yield from out.add(row, 100)
            parts = []
        parts.append(r)
    if parts:
        for row in chain_parts(parts):
            yield from out.add(row, 100)
    yield from out.rest()


def edit_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edit each part between the states at its borders; results leave in chunks of bounded size."""
    out = Sender(_arrow(CHUNK))
    now: dict | None = None

    def send(more: dict) -> Iterator[pa.RecordBatch]:
        row = {"conv_id": now["conv_id"], "part": now["part"], "chunk": now["chunk"]} | now["writer"].flush() | more
        now["chunk"], size, now["size"] = now["chunk"] + 1, now["size"], 0
        yield from out.add(row, size)

    def close() -> Iterator[pa.RecordBatch]:
        if now is not None:
            _, edits = now["best"].finish(None if now["ends"] else now["leave"])
            now["writer"].take(edits)
            yield from send(now["counts"])

    for new, r in _runs(_records(batches), lambda r: (r["conv_id"], r["part"])):
        if new:
            yield from close()
            now = {
                "conv_id": r["conv_id"], "part": r["part"], "chunk": 0, "size": 0, "ends": r["ends"], "leave": r["leave"],
                "best": Survivors(r["enter"]), "writer": Writer(r["enter"]), "counts": {c: r[c] for c in COUNTS},
            }
        writer = now["writer"]
        writer.rows.append((r["role"], r["text"]))
        writer.take(now["best"].push(r["fault"], r["role"][:1]))
        now["size"] += len(r["text"]) + 50
        if now["size"] >= PART_CHARS // 4:
            yield from send({})
    yield from close()
    yield from out.rest()


def hash_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of conversations that come in chunks."""
    out = Sender(_arrow(DIGEST))
    now: dict | None = None

    def close() -> Iterator[pa.RecordBatch]:
        if now is not None:
            audit = "".join(now["audit"])
            yield from out.add({"conv_id": now["conv_id"], "audit": audit, "repaired_sha256": now["hash"].hexdigest()} | now["counts"], len(audit))

    for new, r in _runs((r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()), lambda r: (r["conv_id"],)):
        if new:
            yield from close()
            now = {"conv_id": r["conv_id"], "audit": [], "hash": hashlib.sha256(), "first": True, "counts": {}}
        now["audit"].append(r["audit"])
        for t in r["repaired"]:
            now["hash"].update((("" if now["first"] else "\n") + t["role"] + ":" + t["text"]).encode())
            now["first"] = False
        if r["cost"] is not None:
            now["counts"] = {c: r[c] for c in COUNTS}
    yield from close()
    yield from out.rest()


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations of rows (conv_id, turn, role, text) as chunks: ``conv_id``, ``part``, ``chunk``, counts, ``audit``, ``repaired``.

    A conversation is one chunk with a null ``part``, or, if it is long or lay at a border between tasks, several in the order of
    (``part``, ``chunk``), of which the last has the counts. ``audit`` holds the initials of the edits in order (Delete, Insert,
    Keep, Rerole), ``repaired`` the turns that result. A role or text that is null counts as one space; rows without a conv_id are one
    conversation; rows without a turn come first. Rows of one turn are ordered by a hash of role and text, so equal ones are
    adjacent, and all but the first of them are duplicates. A role with no initial is none of the three. Extra columns are left
    out; an empty table gives an empty one. Memory follows the rows that are not final yet, and single texts, not the conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))).withColumn("_row", F.monotonically_increasing_id())
    # The row number parts equal rows, so that no group of copies has to fit into one task.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    scanned = saved(dealt.mapInArrow(scan, ddl(SCAN)))
    whole = scanned.filter("part IS NULL").select("conv_id", F.lit(None).cast("long").alias("part"), F.lit(0).cast("long").alias("chunk"), *COUNTS, "audit", "repaired")
    return whole.unionByName(_by_parts(scanned.filter("part IS NOT NULL").select("conv_id", "part", "k", "turn", "role", "text", "digest", "fault")))


def _by_parts(rows: DataFrame) -> DataFrame:
    same = lambda a, b, *keys: _all(F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys)
    firsts = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = F.coalesce(F.struct("r.part", "r.k") > F.col("f.first"), F.lit(False))
    fault = F.when(later & (F.col("r.fault") != "blank"), "duplicate").otherwise(F.col("r.fault"))
    flagged = rows.alias("r").join(firsts.alias("f"), same("r", "f", "conv_id", "digest"), "left").select("r.conv_id", "r.part", "r.k", "r.turn", "r.role", "r.text", fault.alias("fault"))
    narrow = flagged.select("conv_id", "part", "k", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    reports = narrow.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "k").mapInArrow(report_parts, ddl(PART))
    paths = saved(reports.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(find_paths, ddl(PATH)))
    guided = flagged.alias("r").join(paths.alias("p"), same("r", "p", "conv_id", "part")).select("r.*", "p.enter", "p.leave", "p.ends", *[f"p.{c}" for c in COUNTS])
    return guided.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "k").mapInArrow(edit_parts, ddl(CHUNK))


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def digests(chunks: DataFrame) -> DataFrame:
    """``conv_id``, counts, ``audit`` and the hash of the repaired ``role:text`` lines of each conversation of ``repair``."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = chunks.filter("part IS NULL").select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    rest = chunks.filter("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return whole.unionByName(rest.mapInArrow(hash_chunks, ddl(DIGEST)))


def repaired_turns(chunks: DataFrame) -> DataFrame:
    """The turns of the repaired conversations as rows (``conv_id``, ``part``, ``chunk``, ``position`` within it, ``role``, ``text``)."""
    return chunks.select("conv_id", "part", "chunk", F.posexplode("repaired").alias("position", "t")).select("conv_id", "part", "chunk", "position", "t.role", "t.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """A fifth each of a quarter of all rows dropped, emptied, freed of ``.!?``, repeated, or given to the user, by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def with_lost(report: DataFrame, conversations: DataFrame) -> DataFrame:
    """``report`` and a row of zeros for each conversation that has no row left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    empty = hashlib.sha256().hexdigest()
    return joined.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
