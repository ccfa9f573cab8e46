"""Token ids in training order: fixed-length sequences, permuted by a keyed bijection, in fixed-stride binary shards.

The tokens of an input partition are packed into sequences of equal length. A first pass counts the
sequences of each partition, which gives every sequence a dense number; a keyed Feistel network over the next even number of
bits, walked until it falls below the number of sequences, turns numbers into slots. No slot table exists:
a slot is computed from its number, and its shard and byte offset from the slot. Each shard is one range of slots
and one file, so a reader seeks to ``offset`` and goes on from any slot.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import pieces
from winnow.llm.store import saved, shared_folder
from winnow.llm.words import mix

ROUNDS = 6


def _halves(n: int) -> int:
    """Bits of one half of the smallest even-sized domain that holds ``n`` values."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _turn(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in keys:
        left, right = right, left ^ (mix(right + k) & low)
    return (left << np.uint64(half)) | right


def _keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([key % (1 << 64)], np.uint64)))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the sequences 0 … n-1 with these numbers: a bijection of 0 … n-1 for each key."""
    half, keys = _halves(n), _keys(key)
    x = _turn(np.asarray(numbers, np.uint64), half, keys)
    while len(out := np.flatnonzero(x >= np.uint64(n))):  # cycle-walking: the domain is at most four times n
        x[out] = _turn(x[out], half, keys)
    return x.astype(np.int64)


def unpermute(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """Numbers of the sequences in these slots."""
    half, keys = _halves(n), _keys(key)
    low = np.uint64((1 << half) - 1)

    def back(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & low), left
        return (left << np.uint64(half)) | right

    x = back(np.asarray(slots, np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = back(x[out])
    return x.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Length of a sequence in tokens, sequences of a shard, and the key of the order. Ids must fit into two bytes."""

    length: int = 1024
    per_shard: int = 8192
    key: int = 20240607
    pad_id: int = 0

    @property
    def stride(self) -> int:
        return 2 * self.length


class Packer:
    """Packs the token lists of a partition into sequences; the last one is filled up with the pad id."""

    def __init__(self, layout: Layout, end_id: int):
        self.layout, self.end = layout, np.array([end_id], np.uint16)
        self.parts: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, list]]:
        rest = np.concatenate([ids.astype(np.uint16), self.end])
        while len(rest):
            take = rest[: self.layout.length - self.n]
            self.parts.append(take)
            self.ids.append(doc_id)
            self.n += len(take)
            rest = rest[len(take) :]
            if self.n == self.layout.length:
                yield self.take()

    def take(self) -> tuple[np.ndarray, int, list]:
        fill = np.full(self.layout.length - self.n, self.layout.pad_id, np.uint16)
        out = np.concatenate([*self.parts, fill]).astype("<u2"), self.n, self.ids
        self.parts, self.ids, self.n = [], [], 0
        return out


def _sequences(batches: Iterator[pa.RecordBatch], shared, layout: Layout) -> Iterator[tuple[np.ndarray, int, list]]:
    encoder = pieces.encoder_of(shared)
    packer = Packer(layout, shared.value.end_id)
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_many(texts)):
                if len(ids):
                    yield from packer.add(doc_id, ids)
    if packer.n:
        yield packer.take()


def sequence_counts(docs: DataFrame, shared, layout: Layout) -> dict[int, int]:
    """Sequences of each input partition: one number per partition comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(1 for _ in _sequences(batches, shared, layout))
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64())})

    return {r.part: r.n for r in docs.select("doc_id", "text").mapInArrow(count, "part int, n long").collect()}


def numbered(docs: DataFrame, shared, layout: Layout, counts: dict[int, int]) -> DataFrame:
    """(slot, n_tokens, doc_ids, record): every sequence with its slot; ``record`` is compressed for the shuffle.

    The plan over ``docs`` is the one that was counted, so partitions hold the same rows; a task whose count differs fails.
    """
    total = sum(counts.values())
    starts = docs.sparkSession.sparkContext.broadcast(dict(zip(sorted(counts), np.cumsum([0, *[counts[p] for p in sorted(counts)]]).tolist())))  # a number per partition
    schema = pa.schema([("slot", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("record", pa.binary())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, press, rows, n = starts.value[part], zstandard.ZstdCompressor(3), [], 0

        def batch() -> pa.RecordBatch:
            slots = permute(np.arange(at + n - len(rows), at + n), total, layout.key)
            return pa.record_batch([pa.array(slots), *(pa.array(c, t.type) for c, t in zip(zip(*rows), list(schema)[1:]))], schema=schema)

        for tokens, size, ids in _sequences(batches, shared, layout):
            rows.append((size, list(dict.fromkeys(ids)), press.compress(tokens.tobytes())))
            n += 1
            if len(rows) == 1024:
                yield batch()
                rows = []
        if rows:
            yield batch()
        if n != counts[part]:
            raise RuntimeError(f"partition {part} held {counts[part]} sequences when they were counted and {n} now")

    return docs.select("doc_id", "text").mapInArrow(number, "slot long, n_tokens long, doc_ids array<long>, record binary")


def _filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, path: str, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write ``docs`` as shards below ``folder`` and return the manifest.

    The manifest has (``slot``, ``shard``, ``offset``, ``n_tokens``, ``doc_ids``) of every sequence. A shard is a file
    of records of ``2 * length`` bytes, little-endian token ids in slot order. It is written under the name of the task attempt and then
    renamed, so a task that is run again leaves the same file. Texts without tokens (null, empty) have no sequence; rows without a
    doc_id are written with a null in ``doc_ids``; repeated rows are written each; an empty table gives no shard. ``folder`` is any
    place that ``pyarrow.fs`` and all executors reach.
    """
    shared = pieces.shared_model(docs, path)
    if len(shared.value.texts) > 1 << 16:
        raise ValueError("token ids must fit into two bytes")
    counts = sequence_counts(docs, shared, layout)
    total = sum(counts.values())
    shards = max(1, -(-total // layout.per_shard))
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps({"sequences": total, "length": layout.length, "per_shard": layout.per_shard, "stride": layout.stride, "key": layout.key, "rounds": ROUNDS}).encode())
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        unpress, out, name, last = zstandard.ZstdDecompressor(), None, "", -1
        for batch in batches:
            slots = batch.column(0).to_numpy()
            for slot, record in zip(slots.tolist(), batch.column(3)):
                shard = slot // layout.per_shard
                if out is None:
                    name = f"{base}/shard-{shard:08d}"
                    temp = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    out, last = files.open_output_stream(temp), shard * layout.per_shard - 1
                if slot != last + 1:
                    raise RuntimeError(f"slot {slot} follows {last}")
                out.write(unpress.decompress(record.as_py()))
                last = slot
            yield pa.record_batch([batch.column(0), pa.array(slots // layout.per_shard), pa.array(slots % layout.per_shard * layout.stride), batch.column(1), batch.column(2)], schema=schema)
        if out is not None:
            out.close()
            files.move(temp, f"{name}.bin")

    dealt = numbered(docs, shared, layout, counts).repartitionById(shards, (F.col("slot") / layout.per_shard).cast("int")).sortWithinPartitions("slot")
    return saved(dealt.mapInArrow(write, "slot long, shard long, offset long, n_tokens long, doc_ids array<long>"))


def read_records(folder: str, first: int, n: int) -> np.ndarray:
    """Token ids of ``n`` sequences from slot ``first`` on: one seek in each shard they lie in."""
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/layout.json") as f:
        lay = json.loads(f.read())
    out = []
    while n > 0 and first < lay["sequences"]:
        shard, at = divmod(first, lay["per_shard"])
        take = min(n, lay["per_shard"] - at, lay["sequences"] - first)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * lay["stride"])
            out.append(np.frombuffer(f.read(take * lay["stride"]), "<u2").reshape(take, lay["length"]))
        first, n = first + take, n - take
    return np.concatenate(out) if out else np.empty((0, lay["length"]), "<u2")


def training_order(docs: DataFrame, path: str, layout: Layout = Layout()) -> DataFrame:
    """The manifest of ``docs`` written below a new folder of the shared one, with the ``folder`` of the shards."""
    folder = shared_folder(docs.sparkSession)
    return write_shards(docs, path, folder, layout).withColumn("folder", F.lit(folder))
