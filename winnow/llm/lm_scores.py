"""Language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts of words and word pairs: a count of level ``q`` is stored as the memberships (n-gram, 1) …
(n-gram, q), and read by probing levels until one is missing. Its size follows from the counted levels, so it holds all n-grams of any
corpus. Up to a size that is a parameter it is broadcast; a larger one stays a table, to whose ranges the documents' n-grams are
sent. Both give the same scores. The model is a bigram model with Dirichlet smoothing,

    P(w | v) = (c(v, w) + m * P(w)) / (c(v) + m),   P(w) = (c(w) + 1) / (N + V + 1),

with counts c(v, w) and c(w) rounded down and c(v) rounded up to the border of their level, so probabilities never sum to more than one but for
false positives of the filter. The context of the first word is the end token.

Counts are exact over all training texts. Tasks send their sorted counts as compressed runs, one for each range of hashes,
and one task merges each range. Beside the model, ``base_score`` uses exact word counts: the most frequent words by a
broadcast of bounded size, all others by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from winnow.llm.store import saved
from winnow.llm.words import WordHashes, lower_words, mix, word_hashes

#: Hash of the token that ends each text.
END = np.uint64(0x5BD1E9955BD1E995)
#: Training tokens that a task holds before it sends a run.
RUN = 4_000_000
UNI, BI = 0, 1


@dataclass(frozen=True)
class Settings:
    #: A filter of up to so many bits is broadcast.
    max_filter_bits: int = 1 << 29
    probes: int = 3
    bits_per_level: int = 8
    #: Levels are 1, 2, 3 … and, from where that is wider, this factor apart.
    base: float = 1.1
    #: Weight of the word distribution under a context, in counts.
    prior: float = 500.0
    #: Words whose exact counts are broadcast, at most (16 bytes each).
    head: int = 1 << 18


def level_borders(base: float) -> np.ndarray:
    """The smallest count of each level."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text has remainder 2 by 7. A null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    """Word hashes and the end token."""
    return np.append(word_hashes(lower_words(text), memo), END)


def pair_hashes(toks: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the end token stands before the first."""
    before = np.concatenate([[END], toks[:-1]])
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(toks))


def _pack(x: np.ndarray) -> bytes:
    """Bytes of 64-bit values by significance, compressed: small values take little."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _runs(kind: int, hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    found, counts = np.unique(hashes, return_counts=True)
    owner = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))
    for r in range(ranges):
        a, b = cuts[r], cuts[r + 1]
        if b > a:
            yield r, kind, _pack(np.diff(found[a:b], prepend=np.uint64(0))), _pack(counts[a:b])


def count_ngrams(texts: DataFrame, ranges: int) -> DataFrame:
    """(part, kind, n, total, hashes, counts): exact counts of the words and pairs of a ``text`` column, a packed run for each range and kind."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, one, two, n = WordHashes(), [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, held in ((UNI, one), (BI, two)):
                rows = list(_runs(kind, np.concatenate(held), ranges))
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                held.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(a, 512).to_pylist():
                    toks = token_hashes(text, memo)
                    one.append(toks)
                    two.append(pair_hashes(toks))
                    n += len(toks)
                    if n >= RUN:
                        yield from send()
                        n = 0
        if n:
            yield from send()

    out = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault((row["part"], row["kind"]), []).append((np.cumsum(_unpack(row["hashes"]), dtype=np.uint64), _unpack(row["counts"])))
        for (part, kind), got in held.items():
            hashes, counts = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(hashes, kind="stable")
            hashes, counts = hashes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            hashes, counts = hashes[first], np.add.reduceat(counts, first)
            row = [[part], [kind], [len(hashes)], [int(counts.sum())], [_pack(np.diff(hashes, prepend=np.uint64(0)))], [_pack(counts)]]
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(row, out)], schema=out)

    sent = texts.select("text").mapInArrow(runs, "part int, kind int, hashes binary, counts binary")
    return sent.repartitionById(ranges, F.col("part")).mapInArrow(merge, "part int, kind int, n long, total long, hashes binary, counts binary")


def probe_places(hashes: np.ndarray, level: int, n: int, size: int) -> Iterator[np.ndarray]:
    """Bits of (n-gram, level). All bits of a hash lie in the segment that its high bits name, so segments are built apart."""
    h = mix(hashes + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    step = mix(h) | np.uint64(1)
    inside = np.uint64(SEGMENT - 1)
    base = (((hashes >> np.uint64(32)) * np.uint64(size // SEGMENT)) >> np.uint64(32)) * np.uint64(SEGMENT)
    for i in range(n):
        yield base + ((h + np.uint64(i) * step) >> np.uint64(20) & inside)


#: Bits of a segment of the filter, and segments that a task holds at a time when the filter is not broadcast (8 MB).
SEGMENT, HELD = 1 << 15, 1 << 11
#: Tokens of the documents that ask together, if not one document alone has more.
ASKING = 1 << 17
#: N-grams asked of one part that are probed together.
ANSWERED = 1 << 18


def levels_of(counts: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, counts, side="right")


def read_levels(hashes: np.ndarray, bits: np.ndarray, probes: int, most: int) -> np.ndarray:
    """Level of each n-gram by repeated membership probes; 0 if it is not stored."""
    found, inverse = np.unique(hashes, return_inverse=True)
    return probed(found, bits, probes, most, len(bits) * 8, 0)[inverse]


def probed(found: np.ndarray, bits: np.ndarray, probes: int, most: int, size: int, start: int) -> np.ndarray:
    """Levels of ``found`` in a filter of ``size`` bits, of which ``bits`` holds those from ``start`` on."""
    level, alive = np.zeros(len(found), np.int64), np.arange(len(found))
    for q in range(1, most + 1):
        h = found[alive]
        has = np.ones(len(h), bool)
        for p in probe_places(h, q, probes, size):
            p = p - np.uint64(start)
            has &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[has]
        if not len(alive):
            break
        level[alive] = q
    return level


def _segments(counted: DataFrame, size: int, settings: Settings) -> DataFrame:
    """(first, bits): the filter's bytes by segment; a segment at a border between ranges has a row from each."""
    borders = level_borders(settings.base)
    ranges = counted.select("part").distinct().count()
    schema = pa.schema([("first", pa.int64()), ("bits", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = np.cumsum(_unpack(row["hashes"]), dtype=np.uint64), _unpack(row["counts"]).astype(np.int64)
                level = levels_of(counts, borders)
                q = 1
                while len(hashes):
                    for p in probe_places(hashes, q, settings.probes, size):
                        seg = p // np.uint64(SEGMENT)
                        starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))  # hashes are sorted, so segments are too
                        for a, b in zip(starts, [*starts[1:], len(p)]):
                            s = int(seg[a])
                            mine = held.setdefault(s, np.zeros(SEGMENT, bool))
                            mine[(p[a:b] % np.uint64(SEGMENT)).astype(np.int64)] = True
                    q += 1
                    more = level >= q
                    hashes, level = hashes[more], level[more]
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], schema=schema)

    return counted.repartition(max(1, ranges), "part").mapInArrow(build, "first long, bits binary")


@dataclass
class Model:
    """What scoring needs; ``bits`` and ``head`` are broadcasts of bounded size, ``bits`` only if the filter fits."""

    bits: Any
    segments: DataFrame
    size: int
    head: Any
    total: int
    distinct: int
    words: DataFrame
    settings: Settings


def train(texts: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of all rows of ``texts`` (a ``text`` column; null is an empty text)."""
    spark = texts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = saved(count_ngrams(texts, ranges))
    row = counted.filter(F.col("kind") == UNI).agg(F.sum("n"), F.sum("total")).first()
    distinct, total = int(row[0] or 0), int(row[1] or 0)
    borders = level_borders(settings.base)

    # Levels to store by count, from which the size and the smallest stored count follow; a row per level.
    @F.pandas_udf(ArrayType(StructType([StructField("level", LongType()), StructField("n", LongType())])))
    def histogram(blobs: pd.Series) -> pd.Series:
        out = []
        for b in blobs:
            level, n = np.unique(levels_of(_unpack(b).astype(np.int64), borders), return_counts=True)
            out.append([(int(q), int(k)) for q, k in zip(level, n)])
        return pd.Series(out, dtype=object)

    per_level = counted.select("kind", F.inline(histogram("counts"))).groupBy("kind", "level").agg(F.sum("n").alias("n")).collect()
    stored = sum(r.level * r.n for r in per_level)
    size = max(SEGMENT, 1 << max(0, stored * settings.bits_per_level - 1).bit_length())
    segments, bits = saved(_segments(counted, size, settings)), None
    if size <= settings.max_filter_bits:
        bits = np.zeros(size // 8, np.uint8)
        for r in segments.toLocalIterator():  # as many bytes as the filter has, twice at range borders
            a = r.first * (SEGMENT // 8)
            bits[a : a + SEGMENT // 8] |= np.frombuffer(r.bits, np.uint8)

    words = saved(_word_counts(counted))
    held, border = 0, 1 << 62
    for q in sorted({r.level for r in per_level if r.kind == UNI}, reverse=True):
        held += sum(r.n for r in per_level if r.kind == UNI and r.level == q)
        if held > settings.head:
            break
        border = int(borders[q - 1])
    head = words.filter(F.col("count") >= border).toPandas().sort_values("word")  # at most settings.head rows
    shared = spark.sparkContext.broadcast
    top = (head["word"].to_numpy(np.int64), head["count"].to_numpy(np.int64))
    return Model(None if bits is None else shared(bits), segments, size, shared(top), total, distinct, words.filter(F.col("count") < border), settings)


def _word_counts(counted: DataFrame) -> DataFrame:
    """(word, count) of all words, by signed hash."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.cumsum(_unpack(row["hashes"]), dtype=np.uint64).view(np.int64)
                yield pa.record_batch({"word": pa.array(words), "count": pa.array(_unpack(row["counts"]).view(np.int64))})

    return counted.filter(F.col("kind") == UNI).select("hashes", "counts").mapInArrow(unpacked, "word long, count long")


def _log_sums(level: np.ndarray, pair_level: np.ndarray, sizes: np.ndarray, total: int, distinct: int, settings: Settings) -> np.ndarray:
    """log10 probability of each text, from the levels of its tokens and of their pairs; ``sizes`` has the tokens of each text."""
    borders = level_borders(settings.base)
    low = np.concatenate([[0], borders]).astype(np.float64)
    high = np.concatenate([[0], borders[1:] - 1, [borders[-1] * 2]]).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = np.roll(level, 1)
    before[starts] = level[starts + sizes - 1]  # the end token
    word = (low[level] + 1) / (total + distinct + 1)
    p = (low[pair_level] + settings.prior * word) / (high[before] + settings.prior)
    return np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)


def _all_pairs(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([pair_hashes(t) for t in np.split(flat, np.cumsum(sizes)[:-1])])


def _grouped(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document (``first`` is null) and one for each group of them, which has their tokens once.

    A group names its distinct words by their sorted hashes and the tokens by their places among them, so frequent words take little.
    ``first`` is the first row of a group and names it.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    head = model.head

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (known_words, known_counts) = WordHashes(), head.value
        held, n = [], 0

        def group(doc: pa.DataType) -> pa.RecordBatch:
            rows, ids, out, toks = zip(*held)
            flat, sizes = np.concatenate(toks), np.array([len(t) for t in toks])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            words, places = np.unique(flat, return_inverse=True)
            known, logs = _head_logs(words, known_words, known_counts)
            known, logs = known[places], logs[places]
            tails = np.concatenate([[0], np.cumsum(np.add.reduceat((~known).astype(np.int64), starts))])
            made = {
                "row": pa.array([*rows, None], pa.int64()), "doc_id": pa.array([*ids, None], doc), "held_out": pa.array([*out, None], pa.bool_()),
                "n_tokens": pa.array([*sizes.tolist(), None], pa.int64()), "head_known": pa.array([*np.add.reduceat(known.astype(np.int64), starts).tolist(), None], pa.int64()),
                "head_sum": pa.array([*np.add.reduceat(logs, starts).tolist(), None], pa.float64()),
                "tail": pa.ListArray.from_arrays(pa.array([*tails.tolist(), tails[-1]], pa.int32()), pa.array(flat[~known].view(np.int64))),
            }
            packed = {"words": _pack(np.diff(words, prepend=np.uint64(0))), "places": _pack(places), "ids": _pack(np.array(rows)), "sizes": _pack(sizes)}
            last = {"first": pa.array([*[None] * len(rows), rows[0]], pa.int64()), **{k: pa.array([*[None] * len(rows), v], pa.binary()) for k, v in packed.items()}}
            return pa.record_batch({**made, **last})

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for row, doc_id, out, text in zip(*(c.to_pylist() for c in part.columns)):
                    held.append((row, doc_id, out, token_hashes(text, memo)))
                    n += len(held[-1][3])
                    if n >= ASKING:
                        yield group(part.column(1).type)
                        held, n = [], 0
        if held:
            yield group(part.column(1).type)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return numbered.mapInArrow(
        make, f"row long, doc_id {doc_type}, held_out boolean, n_tokens long, head_known long, head_sum double, tail array<long>, "
        "first long, words binary, places binary, ids binary, sizes binary"
    )


def _head_logs(words: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is in the broadcast head of the counts, and the logarithm of its count and one there, else 0."""
    if not len(known):
        return np.zeros(len(words), bool), np.zeros(len(words))
    signed = words.view(np.int64)
    at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
    found = known[at] == signed
    return found, np.where(found, np.log10(counts[at] + 1.0), 0.0)


def _tokens(words: bytes, places: bytes) -> np.ndarray:
    return np.cumsum(_unpack(words), dtype=np.uint64)[_unpack(places).astype(np.int64)]


def _asked(groups: DataFrame, size: int) -> DataFrame:
    """(part, first, blob): the distinct n-grams that each group asks of each part of the filter."""
    schema = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("blob", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, words, places, sizes = (c[k].as_py() for c in batch.columns)
                found = np.unique(np.concatenate([np.cumsum(_unpack(words), dtype=np.uint64), _all_pairs(_tokens(words, places), _unpack(sizes).astype(np.int64))]))
                part = (((found >> np.uint64(32)) * np.uint64(size // SEGMENT)) >> np.uint64(32)) // np.uint64(HELD)
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                asks = [(int(part[a]), first, _pack(np.diff(found[a:b], prepend=np.uint64(0)))) for a, b in zip(at, [*at[1:], len(found)])]
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*asks), schema)], schema=schema)

    return groups.select("first", "words", "places", "sizes").mapInArrow(ask, "part long, first long, blob binary")


def scores_by_range(groups: DataFrame, model: Model) -> DataFrame:
    """(row, score) of the documents of ``groups`` (see ``_grouped``), with the filter as a table.

    Each group of documents sends its distinct n-grams to the parts of the filter and gets their levels back. A task holds one part of
    the filter and what some groups ask of it; however frequent an n-gram, a group asks for it once, and groups that are probed together share it.
    """
    s, total, distinct, size = model.settings, model.total, model.distinct, model.size
    most, part_bits = len(level_borders(s.base)), SEGMENT * HELD
    answer = pa.schema([("first", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bits, held, n = -1, np.zeros(0, np.uint8), [], 0

        def answered() -> pa.RecordBatch:
            # Groups share their frequent n-grams, which have the most levels to probe.
            found, inverse = np.unique(np.concatenate([h for _, h in held]), return_inverse=True)
            level = probed(found, bits, s.probes, most, size, part * part_bits)[inverse]
            blobs = [_pack(x) for x in np.split(level, np.cumsum([len(h) for _, h in held])[:-1])]
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(([f for f, _ in held], [part] * len(held), blobs), answer)], schema=answer)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["part"] != part or n >= ANSWERED):
                    yield answered()
                    held, n = [], 0
                if r["part"] != part:
                    part, bits = r["part"], np.zeros(part_bits // 8, np.uint8)
                if not r["asks"]:
                    a = (r["first"] - part * HELD) * (SEGMENT // 8)
                    bits[a : a + SEGMENT // 8] |= np.frombuffer(r["blob"], np.uint8)
                    continue
                held.append((r["first"], np.cumsum(_unpack(r["blob"]), dtype=np.uint64)))
                n += len(held[-1][1])
        if held:
            yield answered()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = []
        for batch in batches:
            for k in range(batch.num_rows):
                _, part, blob, words, places, ids, sizes = (c[k].as_py() for c in batch.columns)
                if part is not None:
                    levels.append(_unpack(blob).astype(np.int64))
                    continue
                # The tokens of a group come after its levels.
                flat, sizes = _tokens(words, places), _unpack(sizes).astype(np.int64)
                _, inverse = np.unique(np.concatenate([flat, _all_pairs(flat, sizes)]), return_inverse=True)
                level, levels = np.concatenate(levels)[inverse], []
                out = _log_sums(level[: len(flat)], level[len(flat) :], sizes, total, distinct, s)
                yield pa.record_batch({"row": pa.array(_unpack(ids).astype(np.int64)), "score": pa.array(out)})

    segments = model.segments.select(F.expr(f"first DIV {HELD}").alias("part"), F.lit(False).alias("asks"), "first", F.col("bits").alias("blob"))
    both = segments.unionByName(_asked(groups, size).select("part", F.lit(True).alias("asks"), "first", "blob"))
    # As a table, so that the files of this shuffle are gone when the tokens are dealt.
    got = saved(both.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(answers, "first long, part long, blob binary"))
    sent = groups.select("first", "words", "places", "ids", "sizes")
    back = got.unionByName(sent, allowMissingColumns=True).select("first", "part", "blob", "words", "places", "ids", "sizes")
    return back.repartition("first").sortWithinPartitions("first", F.asc_nulls_last("part")).mapInArrow(summed, "row long, score double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row of ``docs``.

    A null or empty text is its end token. Rows are scored one by one, so repeated rows stay and an empty
    table stays empty. Only ``doc_id`` and ``text`` are read.
    """
    s, total, distinct = model.settings, model.total, model.distinct
    bits, head, most = model.bits, model.head, len(level_borders(model.settings.base))
    fields = [("n_tokens", LongType()), ("head_known", LongType()), ("head_sum", DoubleType()), ("score", DoubleType()), ("tail", ArrayType(LongType()))]

    @F.pandas_udf(StructType([StructField(n, t) for n, t in fields]))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        words, counts = head.value
        for texts in batches:
            parts = []
            for a in range(0, len(texts), 256):
                toks = [token_hashes(t, memo) for t in texts.iloc[a : a + 256]]
                sizes = np.array([len(t) for t in toks])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                flat = np.concatenate(toks)
                level, pair_level = (read_levels(h, bits.value, s.probes, most) for h in (flat, _all_pairs(flat, sizes)))
                found = _log_sums(level, pair_level, sizes, total, distinct, s)
                known, logs = _head_logs(flat, words, counts)
                ends = np.split(np.arange(len(flat)), starts[1:])
                parts.append(pd.DataFrame({
                    "n_tokens": sizes, "head_known": np.add.reduceat(known.astype(np.int64), starts), "head_sum": np.add.reduceat(logs, starts),
                    "score": found, "tail": [flat[e][~known[e]].view(np.int64) for e in ends],
                }))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=[n for n, _ in fields])

    if bits is None:
        grouped = saved(_grouped(docs, model))
        rows = grouped.filter("first is null").select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "tail")
        rows = rows.join(saved(scores_by_range(grouped.filter("first is not null"), model)), "row")
    else:
        scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.asNondeterministic()("text").alias("s"))
        rows = saved(scored.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "s.*"))
    tail = rows.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n")).join(model.words, "word")
    sums = tail.groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("count") + 1.0)).alias("sum"))
    return rows.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), "score",
    )


def scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    return score_documents(docs, train(docs.filter(~held_out(F.col("doc_id"))).select("text"), settings))
