"""Periodic runs of words, found with suffix trees, and texts without the repeats.

A run is a stretch of words with a smallest period ``q`` (words ``q`` apart are the same) that holds the
period at least twice and that no neighbouring word extends. Each run has a Lyndon root that is the longest
Lyndon word at its place under one of two word orders (the order of ids and its opposite). So the longest
Lyndon word of each place is a candidate, and two common-extension queries say how far its period reaches to
both sides: one on Ukkonen's suffix tree of the words, one on that of the words in reverse. The common extension of two
places is the depth of the lowest common ancestor of their leaves, a range minimum over an Euler tour.

Every word of a run of at least ``min_length`` words lies in a window of ``ceil(min_length / 2)`` words that occurs
twice in the document. Trees are built for the stretches of such windows only; elsewhere no run is possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.words import gram_hashes, mix

#: Shortest run in words.
MIN_LENGTH = 12
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of ids from 1 on; an end mark, id 0, is put behind it."""

    def __init__(self, ids: list[int]):
        text = [*ids, 0]
        n, k = len(text), max(text) + 1
        first, last, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = at = size = pending = 0
        for i, c in enumerate(text):
            pending += 1
            fresh = 0  # the inner node that still waits for its suffix link
            while pending:
                if not size:
                    at = i
                key = node * k + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    begin = first[child]
                    length = min(last[child], i + 1) - begin
                    if size >= length:
                        at, size, node = at + length, size - length, child
                        continue
                    if text[begin + size] == c:
                        size += 1
                        if fresh:
                            link[fresh] = node
                        break
                    inner = len(first)
                    first += (begin, i)
                    last += (begin + size, n)
                    link += (0, 0)
                    edges[key] = inner
                    first[child] = begin + size
                    edges[inner * k + text[begin + size]] = child
                    edges[inner * k + c] = inner + 1
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                pending -= 1
                if node:
                    node = link[node]
                elif size:
                    size -= 1
                    at = i - pending + 1
        self.n = n
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self._parent, self._word = keys // k, keys % k
        self._child = np.fromiter(edges.values(), np.int64, len(edges))
        self._length = np.asarray(last, np.int64) - np.asarray(first, np.int64)

    def tour(self, opposite: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their leaves, and the depth of the lowest common ancestor of neighbours.

        ``opposite`` turns the order of words round; the end mark stays the smallest.
        """
        word = np.where(self._word > 0, -self._word, -np.int64(2**62)) if opposite else self._word
        # Children are put on the stack from the last to the first.
        order = np.lexsort((-word, self._parent))
        parents = self._parent[order]
        children = self._child[order].tolist()
        nodes = len(self._length)
        low = np.searchsorted(parents, np.arange(nodes)).tolist()
        high = np.searchsorted(parents, np.arange(nodes), side="right").tolist()
        length = self._length.tolist()
        depth, above = [0] * nodes, [0] * nodes
        suffixes, gaps = [], []
        stack, left_leaf = [0], False
        while stack:
            v = stack.pop()
            if left_leaf:
                gaps.append(above[v])
                left_leaf = False
            a, b = low[v], high[v]
            d = depth[v]
            if a == b:
                suffixes.append(self.n - d)
                left_leaf = True
            else:
                below = children[a:b]
                for w in below:
                    above[w] = d
                    depth[w] = d + length[w]
                stack += below
        return np.asarray(suffixes, np.int64), np.asarray(gaps, np.int32)


class Extensions:
    """Longest common extension of any two places, by a range minimum over the tour of the tree."""

    def __init__(self, suffixes: np.ndarray, gaps: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self._minima = [gaps]
        step = 1
        while 2 * step <= len(gaps):
            level = self._minima[-1]
            self._minima.append(np.minimum(level[:-step], level[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Element by element, for places ``i != j``; a place behind the last word extends by nothing."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            rows = level == k
            table = self._minima[k]
            out[rows] = np.minimum(table[a[rows]], table[b[rows] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of a smaller suffix: the end of its longest Lyndon word."""
    n = len(rank)
    out = [n] * n
    open_places: list[int] = []
    for i, r in enumerate(rank):
        while open_places and rank[open_places[-1]] > r:
            out[open_places.pop()] = i
        open_places.append(i)
    return np.asarray(out, np.int64)


def stretch_runs(ids: list[int], min_length: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``ids`` (from 1 on) with at least ``min_length`` words."""
    n = len(ids)
    tree = SuffixTree(ids)
    forward = Extensions(*tree.tour())
    opposite = np.empty(n + 1, np.int64)
    opposite[tree.tour(opposite=True)[0]] = np.arange(n + 1)
    del tree
    backward = Extensions(*SuffixTree(ids[::-1]).tour())
    place = np.tile(np.arange(n), 2)
    end = np.concatenate([next_smaller(r[:n].tolist()) for r in (forward.rank, opposite)])
    right = forward(place, end)
    left = np.zeros(2 * n, np.int64)
    inner = place > 0
    left[inner] = backward(n - place[inner], n - end[inner])
    start, period = place - left, end - place
    length = end + right - start
    found = np.stack([start, length, period], axis=1)[length >= np.maximum(min_length, 2 * period)]
    return np.unique(found, axis=0)


def word_runs(words: list, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``words``, by start, then period."""
    none = np.empty((0, 3), np.int64)
    width = (min_length + 1) // 2
    if len(words) < max(min_length, 2):
        return none
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words))
    grams = gram_hashes(mix(ids.astype(np.uint64)), max(width, 1))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return none
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    # Stretches of words inside windows that occur twice.
    step = np.zeros(len(words) + 1, np.int64)
    step[:-width][twice] += 1
    step[width:][twice] -= 1
    inside = np.concatenate([[False], np.cumsum(step) > 0])
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    parts = []
    for a, b in zip(borders[::2], borders[1::2]):
        if b - a >= min_length:
            local = np.unique(ids[a:b], return_inverse=True)[1] + 1
            runs = stretch_runs(local.tolist(), min_length)
            runs[:, 0] += a
            parts.append(runs)
    if not parts:
        return none
    runs = np.concatenate(parts)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, each run cut to its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def runs_of(text: Column | str, min_length: int = MIN_LENGTH) -> Column:
    """Struct of SCHEMA for a text column."""

    @F.pandas_udf(SCHEMA)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = text.encode().split() if text else []
                runs = word_runs(words, min_length)
                spans = [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()]
                rows.append((len(words), spans, collapsed(words, runs).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed_text"])

    return find.asNondeterministic()(text)  # so that its fields share one evaluation


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed_text``.

    ``collapsed_text`` leaves out the words of each run after its first period and joins the rest by one space.
    A null or empty text has no words, no runs and an empty ``collapsed_text``. Rows are judged one by one: repeated rows
    stay, an empty table stays empty, and a column of ``docs`` with the name of a result is replaced by it.
    Of two runs at the same start the one with the smaller period comes first. Time and memory grow with the words in repeated
    windows (times the logarithm of the longest stretch for memory); a long text without repeats builds no tree.
    """
    new = ["n_words", "runs", "collapsed_text"]
    keep = [c for c in docs.columns if c not in new]
    return docs.withColumn("_found", runs_of("text", min_length)).select(*keep, *[F.col(f"_found.{c}").alias(c) for c in new])


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts go on with copies of a period of their own, by checksum of ``doc_id``.

    With ``h = crc32(doc_id)`` and ``g = h // 10``, a text of ``n > 0`` words with ``h % 10 = 0`` repeats, from word ``a = g % n`` on, its
    ``p = 1 + (n - a) // (3 + g % 8)`` words from there. Other texts, and those of rows without a doc_id, stay as they are.
    """

    @F.pandas_udf("string")
    def repeat(texts: pd.Series, checks: pd.Series) -> pd.Series:
        out = []
        for text, h in zip(texts, checks):
            words = text.encode().split() if text and h == h and int(h) % 10 == 0 else []
            if words:
                g, n = int(h) // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                times = -(-(n - a) // p)
                text = b" ".join(words[:a] + (words[a : a + p] * times)[: n - a]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", repeat("text", F.crc32(F.col("doc_id").cast("string"))))


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the longest one (then smallest start, then period) and hashes of all runs and of the kept words."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.withColumn("_top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), (-F.col("_top.n")).alias("length"), F.col("_top.period").alias("period"),
        F.expr("(-1000 * _top.n) div _top.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text"), 256).alias("collapsed_sha256"),
    )
