"""Benchmark decontamination by spaced-seed hashing.

A mask hashes some token positions of a window and ignores the others, so a window that differs at
ignored positions keeps its hash. All windows of all test items are hashed under all masks; windows
of the documents with the same hash are hits. Around each hit the texts are aligned without gaps and the run with
most matching tokens, which may hold substitutions as long as its score is positive, decides.

Documents are read once. A filter of fixed size over the test hashes lets most windows go at once; the join
with the hashes themselves removes its false positives, so its size bears on speed and never on results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from winnow.llm.store import saved
from winnow.llm.words import WordHashes, mix, word_hashes

_APART = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


@dataclass(frozen=True)
class Seeds:
    """Masks and thresholds. 1 marks a token that is compared."""

    masks: tuple[str, ...] = ("1110010111", "1101100111", "1011101011", "1111001101")
    #: Items with fewer tokens say nothing about a document.
    min_item: int = 5
    #: A run counts with this many matching tokens, or this percentage of a shorter item.
    min_match: int = 12
    short_percent: int = 80
    #: What a substitution costs against a match.
    penalty: int = 2
    filter_bits: int = 23

    @property
    def span(self) -> int:
        return max(map(len, self.masks))

    def needed(self, n_item: int) -> int:
        return min(self.min_match, -(-n_item * self.short_percent // 100))


DEFAULT_SEEDS = Seeds()


def tokens(text: str | None, memo: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased words of a text, taken apart at ASCII punctuation too."""
    return word_hashes(text.lower().encode().translate(_APART).split(), memo) if text else np.empty(0, np.uint64)


def seed_hashes(toks: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(toks) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + toks[i : i + n]
    return mix(out)


def all_masks(seeds: Seeds, short: list[int]) -> list[str]:
    """The masks, and those for each length of items that are shorter than the span."""
    return [*seeds.masks, *[m for n in short for m in short_masks(seeds, n)]]


def short_masks(seeds: Seeds, n: int) -> list[str]:
    """Masks that ignore any tokens an item of ``n`` may lack. One ignored at an end makes the mask shorter, so no token need stand there."""
    return sorted({"".join("01"[i not in gone] for i in range(n)).strip("0") for gone in combinations(range(n), n - seeds.needed(n))})


def item_table(benchmark: DataFrame, seeds: Seeds = DEFAULT_SEEDS) -> tuple[DataFrame, list[int]]:
    """(item_id, tokens) of the items, and the lengths of those shorter than the span (fewer than ``span`` values)."""

    @F.pandas_udf(ArrayType(LongType()))
    def toks(texts: pd.Series) -> pd.Series:
        memo = WordHashes()
        return pd.Series([tokens(t, memo).view(np.int64) for t in texts], dtype=object)

    items = saved(benchmark.select("item_id", toks("text").alias("tokens")).filter(F.size("tokens") >= seeds.min_item))
    n = F.size("tokens")
    short = [r[0] for r in items.filter(n < seeds.span).select(n.alias("n")).distinct().collect()]
    return items, sorted(short)


def item_seeds(items: DataFrame, seeds: Seeds, short: list[int]) -> DataFrame:
    """(seed, item_id, item_pos): each window of each item. An item shorter than the span has masks of its own."""
    masks = all_masks(seeds, short)

    @F.pandas_udf(ArrayType(StructType([StructField("seed", LongType()), StructField("item_pos", IntegerType())])))
    def windows(lists: pd.Series) -> pd.Series:
        out = []
        for x in lists:
            t = np.asarray(x, np.int64).view(np.uint64)
            found, own = [], set(short_masks(seeds, len(t))) if len(t) < seeds.span else set()
            for k, m in enumerate(masks):
                if k < len(seeds.masks) and len(t) >= seeds.span or k >= len(seeds.masks) and m in own:
                    found += [(int(s), i) for i, s in enumerate(seed_hashes(t, m, k).view(np.int64))]
            out.append(found)
        return pd.Series(out, dtype=object)

    return items.select("item_id", F.inline(windows("tokens")))


def seed_filter(table: DataFrame, bits: int) -> np.ndarray:
    """A bit set of ``2 ** bits`` bits with two bits for each seed; no more than its own size reaches the driver."""
    size = 1 << bits
    places = F.array(F.col("seed").bitwiseAND(size - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(size - 1))
    p = table.select(F.explode(places).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    rows = p.groupBy(F.expr("p DIV 64").alias("w")).agg(F.bit_or(bit).alias("b")).collect()
    out = np.zeros(max(1, size // 64), np.uint64)
    for w, b in rows:
        out[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return out


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    size = np.uint64(len(bits) * 64 - 1)

    def has(p: np.ndarray) -> np.ndarray:
        return (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1

    first = np.flatnonzero(has(hashes & size))
    return first[has((hashes[first] >> np.uint64(32)) & size)]


def hit_segments(docs: DataFrame, table: DataFrame, seeds: Seeds, short: list[int], reach: int) -> DataFrame:
    """(doc_id, seg, toks, seeds, places): stretches of a document around windows that pass the filter.

    A stretch has the ``reach`` tokens (an item's greatest length) on both sides of its hits, so every
    alignment with an item lies inside; stretches that meet are one.
    """
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(table, seeds.filter_bits))
    masks = all_masks(seeds, short)
    lists = lambda t: ArrayType(ArrayType(t))

    @F.pandas_udf(StructType([StructField("toks", lists(LongType())), StructField("seeds", lists(LongType())), StructField("places", lists(IntegerType()))]))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for texts in batches:
            yield pd.DataFrame([segments_of(tokens(t, memo), masks, bits.value, reach) for t in texts], columns=["toks", "seeds", "places"])

    found = docs.select("doc_id", scan.asNondeterministic()("text").alias("s")).filter("s.toks is not null")
    parts = F.explode(F.arrays_zip(F.col("s.toks").alias("toks"), F.col("s.seeds").alias("seeds"), F.col("s.places").alias("places")))
    return found.select("doc_id", parts.alias("p")).select("doc_id", F.monotonically_increasing_id().alias("seg"), "p.toks", "p.seeds", "p.places")


def segments_of(toks: np.ndarray, masks: list[str], bits: np.ndarray, reach: int):
    at, found = [], []
    for k, m in enumerate(masks):
        h = seed_hashes(toks, m, k)
        p = passes(h, bits)
        at.append(p)
        found.append(h[p])
    at, found = np.concatenate(at), np.concatenate(found)
    if not len(at):
        return None, None, None
    order = np.argsort(at, kind="stable")
    at, found = at[order], found[order].view(np.int64)
    cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
    out = ([], [], [])
    for places, hashes in zip(np.split(at, cuts), np.split(found, cuts)):
        start = max(0, int(places[0]) - reach)
        out[0].append(toks[start : int(places[-1]) + reach].view(np.int64))
        out[1].append(hashes)
        out[2].append((places - start).astype(np.int32))
    return out


def best_run(doc: np.ndarray, item: np.ndarray, shift: int, penalty: int) -> tuple[int, int, int, int]:
    """(matches, length, start in doc, start in item) of the run with most matches and a positive score when item token i meets doc token i + shift.

    Of runs with as many matches the shortest counts, and of these the first.
    """
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[a:b] == doc[a + shift : b + shift]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    lowest = np.minimum.accumulate(score)
    # The earliest start from which the score is positive leaves no matches out.
    starts = np.minimum(np.searchsorted(-lowest, -score, side="right"), np.arange(len(score)))
    matches = np.concatenate([[0], np.cumsum(same)])
    inside = matches - matches[starts]
    most = int(inside.max())
    if not most:
        return 0, 0, a + shift, a
    hits, ends = np.flatnonzero(same), np.flatnonzero(inside == most)
    first = hits[np.searchsorted(hits, starts[ends])]
    k = int(np.argmin(ends - first))
    return most, int(ends[k] - first[k]), a + int(first[k]) + shift, a + int(first[k])


def contaminated(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = DEFAULT_SEEDS) -> DataFrame:
    """(``doc_id``, ``item_id``, ``n_match``, ``n_tokens``, ``item_start``): the best overlap of each document with each item that it holds.

    Null and empty texts have no tokens. Rows that repeat a doc_id are one document. An empty table on
    either side gives an empty result. Other columns are not read.
    """
    items, short = item_table(benchmark, seeds)
    table = saved(item_seeds(items, seeds, short))
    reach = max(seeds.span, items.agg(F.max(F.size("tokens"))).first()[0] or 0)
    segs = saved(hit_segments(docs, table, seeds, short, reach))
    # A seed of a much repeated passage is in very many rows, so either side is dealt by a salt too.
    salts = 16
    salt = F.pmod(F.xxhash64("seg"), F.lit(salts))
    hits = segs.select("seg", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("seg", salt.alias("salt"), F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    wide = table.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    found = hits.join(wide, ["seed", "salt"]).select("seg", "item_id", (F.col("place") - F.col("item_pos")).alias("shift")).distinct()

    @F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("n_match", "n_tokens", "doc_start", "item_start")]))
    def runs(doc: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
        got = [best_run(np.asarray(d), np.asarray(i), int(s), seeds.penalty) for d, i, s in zip(doc, item, shift)]
        return pd.DataFrame(np.array(got, np.int32).reshape(-1, 4), columns=["n_match", "n_tokens", "doc_start", "item_start"])

    needed = F.least(F.lit(seeds.min_match), F.ceil(F.size("tokens") * seeds.short_percent / 100))
    aligned = (
        found.join(segs.select("seg", "doc_id", "toks"), "seg").join(items, "item_id")
        .select("doc_id", "item_id", needed.alias("needed"), runs.asNondeterministic()("toks", "tokens", "shift").alias("r"))
        .filter(F.col("r.n_match") >= F.col("needed"))
    )
    return aligned.groupBy("doc_id", "item_id").agg(F.max(F.struct("r.n_match", -F.col("r.n_tokens"), -F.col("r.item_start"))).alias("m")).select(
        "doc_id", "item_id", F.col("m.n_match").cast("long").alias("n_match"), (-F.col("m.col2")).cast("long").alias("n_tokens"), (-F.col("m.col3")).cast("long").alias("item_start")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = DEFAULT_SEEDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. A row without a doc_id cannot be named and stays."""
    return docs.join(contaminated(docs, benchmark, seeds).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
