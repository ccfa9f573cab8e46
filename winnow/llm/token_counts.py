"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The tokenizer is byte-pair encoding with word ends (``tokenizers`` JSON). White space separates its
input, so the count at a prefix is the count of the complete chunks before it plus the count of the
cut chunk. Inside a chunk, ``plain`` gives for each prefix the last token of its encoding and the
number of tokens, as if the word went on; ``ended`` closes the word there. Both follow from a shorter prefix: the
last token is the one suffix of the prefix that is in the vocabulary and that byte-pair encoding would
put after the last token of what stands before it. No prefix is encoded again, and words that begin alike
share the states of their common prefixes. The whole of a text needs ``ended`` at the full chunks only, and the cut at a budget
needs it inside one chunk, the one that passes the budget.

Chunks that the tokenizer's normaliser would change in other ways than lower-casing letter by
letter are handed to the library prefix by prefix.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Entries of a task's memo of chunks; it starts anew when full (about 150 bytes each).
MEMO = 1_000_000
#: Chunks of more bytes are not kept in the memo.
KEPT_BYTES = 40
#: Entries of a task's memo of prefixes; it starts anew when full (about 200 bytes each).
PREFIXES = 1_000_000
#: Bits of a token id, moved up by one, in a state that is kept as one number.
ID_BITS = 24
#: Chunks of up to this many bytes have counts that fit into a byte.
SMALL = 255
END = "</w>"
#: Fixed value: how the tokenizer splits a chunk.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def _unpacked(state: bytes) -> tuple[array, bytes, bytes]:
    """Last tokens, numbers of tokens and numbers at an end; the first byte counts the former two."""
    n = state[0]
    return array("i", state[1 : 1 + 4 * n]), state[1 + 4 * n : 1 + 5 * n], state[1 + 5 * n :]


class PrefixCounter(dict):
    """Memo from a chunk of up to ``SMALL`` bytes (UTF-8, without white space) to its counts at each of its prefixes, a byte each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("the vocabulary must be byte-pair encoding with word ends")
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(ids[x], ids[y]): i for i, (x, y) in enumerate(pairs)}
        plain = {t: i for t, i in ids.items() if not t.endswith(END)}
        closing = {t.removesuffix(END): i for t, i in ids.items() if t.endswith(END)}
        #: Ids of a string as a token inside a word and as one at its end; -1 for none.
        self.both = {t: (plain.get(t, -1), closing.get(t, -1)) for t in {*plain, *closing}}
        #: Length of the longest token that ends in two given characters.
        self.reach: dict[str, int] = {}
        for t in self.both:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        self.plain, self.closing = plain, closing
        self.edges = self._edges({ids[x + y]: (ids[x], ids[y], i) for i, (x, y) in reversed([*enumerate(pairs)])}, ids.values())
        self.alphabet = byte_alphabet()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.fits: dict[tuple[int, int], bool] = {}
        #: For the beginnings of words, as one string of bytes (see ``_unpacked``): the last token and the number of tokens at each of
        #: their prefixes as if the word went on, and the numbers if it ends there. One that was met as a whole word lacks the first two of its full length.
        self.prefixes: dict[str, bytes] = {}
        #: For the beginnings of words, the number of tokens and the last token as if the word went on, in one number.
        self.begun: dict[str, int] = {}
        self.totals = ChunkTotals(self)

    @staticmethod
    def _edges(made: dict[int, tuple[int, int, int]], tokens) -> dict[int, tuple[list, list]]:
        """For each token, the tokens that stand at its right and at its left edge while it is merged, each
        with the rank of the merge that takes it in; the token itself stays."""
        out = {}
        for t in tokens:
            both = []
            for side in (1, 0):
                at, limit, edge = t, 1 << 60, []
                edge.append((at, limit))
                while at in made:
                    limit = made[at][2]
                    at = made[at][side]
                    edge.append((at, limit))
                both.append(edge)
            out[t] = tuple(both)
        return out

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text.isascii() and text.isalpha() and not self.special.search(text):  # one piece
            out = bytes(self.piece_counts(text.lower()))
        else:
            out = b""
        if len(out) != len(text):
            out = self.chunk_counts(text).astype(np.uint8).tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(chunk) <= KEPT_BYTES:
            self[chunk] = out
        return out

    def follows(self, left: int, right: int) -> bool:
        """Whether encoding leaves these two tokens as they are when they stand side by side: no pair across
        their border merges before both of its sides are taken into larger tokens. Equal ranks go left to right."""
        key = (left, right)
        got = self.fits.get(key)
        if got is None:
            ranks, lefts = self.ranks, self.edges[right][1]
            got = True
            for x, x_limit in self.edges[left][0]:
                for y, y_limit in lefts:
                    rank = ranks.get((x, y))
                    if rank is not None and rank < x_limit and rank <= y_limit:
                        got = False
                        break
                if not got:
                    break
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
            self.fits[key] = got
        return got

    def piece_counts(self, piece: str) -> Sequence[int]:
        """Counts at the prefixes of one pre-token that end a character, from those of the longest beginning that was met before."""
        if piece.isascii() and piece.isprintable():
            word, ends = piece, None
        else:
            symbols, ends = [], set()
            for ch in piece:
                symbols += [self.alphabet[b] for b in ch.encode()]
                ends.add(len(symbols))
            word = "".join(symbols)
        n = len(word)
        known = self.prefixes
        if n <= KEPT_BYTES and word in known:
            return _unpacked(known[word])[2]
        both, reach, follows, fits = self.both.get, self.reach.get, self.follows, self.fits.get
        last, count, out = [-1], [0], []
        start = 1
        for i in range(min(n - 1, KEPT_BYTES), 0, -1):  # the longest beginning that another word has, and does not end with
            got = known.get(word[:i])
            if got is not None and got[0] > i:
                last, count, out = map(list, _unpacked(got))
                start = i + 1
                break
        for i in range(start, n + 1):
            open_, want = i < n, ends is None or i in ends
            for j in range(max(0, i - reach(word[i - 2 : i], 1)) if i > 1 else 0, i):  # the longest suffix first
                pair = both(word[j:i])
                if pair is None:
                    continue
                inside, closing = pair
                if open_ and inside >= 0:
                    ok = not j or fits((last[j], inside))
                    if follows(last[j], inside) if ok is None else ok:
                        last.append(inside)
                        count.append(count[j] + 1)
                        open_ = False
                        if not want:
                            break
                if want and closing >= 0:
                    ok = not j or fits((last[j], closing))
                    if follows(last[j], closing) if ok is None else ok:
                        out.append(count[j] + 1)
                        want = False
                        if not open_:
                            break
            if open_:  # no token
                last.append(-1)
                count.append(0)
            if i <= KEPT_BYTES:
                if len(known) >= PREFIXES:
                    known.clear()
                known[word[:i]] = bytes((len(last),)) + array("i", last).tobytes() + bytes(count) + bytes(out)
        return out

    def piece_total(self, piece: str) -> int:
        """Count of one whole pre-token: the states of its prefixes as in ``piece_counts``, and an end after the last only."""
        word = piece if piece.isascii() and piece.isprintable() else "".join(self.alphabet[b] for b in piece.encode())
        n = len(word)
        known, reach, follows, fits = self.begun, self.reach.get, self.follows, self.fits.get
        last, count = [-1] * n, [0] * n
        tokens = self.plain.get
        for i in range(1, n + 1):
            kept = i < n and i <= KEPT_BYTES
            if kept:
                got = known.get(word[:i])
                if got is not None:
                    last[i], count[i] = (got & (1 << ID_BITS) - 1) - 1, got >> ID_BITS
                    continue
            if i == n:
                tokens = self.closing.get
            for j in range(max(0, i - reach(word[i - 2 : i], 1)) if i > 1 else 0, i):  # the longest suffix first
                token = tokens(word[j:i])
                if token is None:
                    continue
                ok = not j or fits((last[j], token))
                if follows(last[j], token) if ok is None else ok:
                    if i == n:
                        return count[j] + 1
                    last[i], count[i] = token, count[j] + 1
                    break
            if kept:
                if len(known) >= PREFIXES:
                    known.clear()
                known[word[:i]] = count[i] << ID_BITS | last[i] + 1
        raise ValueError(f"no token ends {piece!r}")

    def chunk_counts(self, chunk: str) -> np.ndarray:
        """Counts at each prefix of a chunk. A special token in it counts as one, once it is complete."""
        found = self.special.search(chunk)
        if not found:
            return self.ordinary_counts(chunk)
        head = self.ordinary_counts(chunk[: found.end() - 1])
        done = (head[found.start() - 1] if found.start() else 0) + 1
        rest = self.chunk_counts(chunk[found.end() :]) if found.end() < len(chunk) else np.empty(0, np.uint32)
        return np.concatenate([head, [done], done + rest]).astype(np.uint32)

    def lowered(self, chunk: str) -> str | None:
        """The chunk as the tokenizer's normaliser leaves it, if that changes letter by letter."""
        low = chunk.lower()
        if chunk.isascii() or (
            len(low) == len(chunk) and unicodedata.is_normalized("NFC", chunk) and all(c.lower() == x for c, x in zip(chunk, low)) and re.search(r"\s", chunk) is None
        ):
            return low
        return None

    def ordinary_counts(self, chunk: str) -> np.ndarray:
        low = self.lowered(chunk)
        if low is None:
            return self.odd_counts(chunk)
        out: list[int] = []
        before = 0
        for piece in PIECES.findall(low):
            if piece[0] == "'" and piece[1:2].isalpha():  # until it is complete, the letters of a contraction stand apart
                counts = [*self.piece_counts("'"), *[self.piece_counts("'")[0] + c for c in self.piece_counts(piece[1:-1] or "x")[: len(piece) - 2]], self.piece_counts(piece)[-1]]
            else:
                counts = self.piece_counts(piece)
            out += [before + c for c in counts]
            before = out[-1]
        return np.array(out, np.uint32) if len(out) == len(chunk) else self.odd_counts(chunk)

    def odd_counts(self, chunk: str) -> np.ndarray:
        """By the library. A cut before ASCII punctuation that follows a letter or number changes no token."""
        out, before = [], 0
        for part in re.split(r"(?<=[^\W_İ])(?=[!-/:-@\[-`{-~])", chunk):
            out.append(before + self.by_library(part))
            before = int(out[-1][-1])
        return np.concatenate(out)

    def by_library(self, chunk: str) -> np.ndarray:
        """Counts of each prefix from the library; a long chunk's prefixes go in batches."""
        out = np.empty(len(chunk), np.uint32)
        step = max(1, 1_000_000 // len(chunk))
        for a in range(0, len(chunk), step):
            batch = [chunk[: i + 1] for i in range(a, min(a + step, len(chunk)))]
            out[a : a + len(batch)] = [len(e.ids) for e in self.library.encode_batch(batch, add_special_tokens=False)]
        return out

    def text_counts(self, text: str) -> np.ndarray:
        """Counts at all prefixes of a whole text, one for each code point."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        space = (points == 32) | (points - 9 < 5)  # unsigned: below 9 wraps around
        inner = np.zeros(len(points), np.int64)
        chunks = text.encode().split()
        if len(max(chunks, key=len, default=b"")) <= SMALL:
            inner[~space] = np.frombuffer(b"".join(map(self.__getitem__, chunks)), np.uint8)
        else:
            inner[~space] = np.concatenate([np.frombuffer(self[c], np.uint8) if len(c) <= SMALL else self.chunk_counts(c.decode()) for c in chunks])
        ends = ~space
        ends[:-1] &= space[1:]
        done = np.cumsum(np.where(ends, inner, 0))  # of the chunks that are complete
        return np.where(ends, done, done + inner)


    def text_total(self, text: str, limit: int) -> tuple[int, int]:
        """The count of a whole text, and the code points of its longest prefix within ``limit``: ``text_counts`` without the counts in between."""
        chunks = text.encode().split()
        found = list(map(self.totals.__getitem__, chunks))
        total = sum(found)
        if total <= limit:
            return total, len(text)
        if limit < 0:
            return total, 0
        done = np.cumsum(found)
        k = int(np.searchsorted(done, limit, side="right"))  # the chunk that passes the limit
        inner = self.chunk_counts(chunks[k].decode()) + (int(done[k - 1]) if k else 0)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        space = (points == 32) | (points - 9 < 5)
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))[k]
        return total, int(start) + _within(inner, limit)


class ChunkTotals(dict):
    """Memo from a chunk (UTF-8, without white space) to its count."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: bytes) -> int:
        text, c = chunk.decode(), self.counter
        out = None
        if c.special.search(text):
            out = int(c.chunk_counts(text)[-1])
        elif (low := c.lowered(text)) is not None:
            found = (low,) if low.isascii() and low.isalpha() else PIECES.findall(low)
            if sum(map(len, found)) == len(low):
                out = sum(map(c.piece_total, found))
        if out is None:
            out = len(c.library.encode(text, add_special_tokens=False).ids)
        if len(self) >= MEMO:
            self.clear()
        if len(chunk) <= KEPT_BYTES:
            self[chunk] = out
        return out


def _counter(path: str, made: dict) -> PrefixCounter:
    if path not in made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made[path] = PrefixCounter(path)
    return made[path]


_MADE: dict[str, PrefixCounter] = {}  # of this worker process


def prefix_counts(text: Column | str, path: str) -> Column:
    """Binary column with the count at every prefix of a text: ``<i4`` differences, one per code point, compressed.

    A null text is empty. ``counts_at``, ``longest_prefix`` and ``read_counts`` answer from it.
    """

    @F.pandas_udf(BinaryType())
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        counter = _counter(path, _MADE)
        for texts in batches:
            yield pd.Series([zlib.compress(np.diff(counter.text_counts(t), prepend=0).astype("<i4").tobytes(), 1) if t else b"" for t in texts], dtype=object)

    return store(text)


def read_counts(stored: bytes | None) -> np.ndarray:
    import zlib

    return np.cumsum(np.frombuffer(zlib.decompress(stored), "<i4")) if stored else np.empty(0, np.int64)


def counts_at(stored: Column | str, chars: Column | str) -> Column:
    """Tokens of the first ``chars`` code points (all of them, if there are fewer) from a stored column."""

    @F.pandas_udf(LongType())
    def at(s: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for blob, k in zip(s, n):
            counts = read_counts(blob)
            k = min(int(k), len(counts))
            out.append(int(counts[k - 1]) if k > 0 else 0)
        return pd.Series(out, dtype="int64")

    return at(stored, chars)


def longest_prefix(stored: Column | str, budget: int) -> Column:
    """Code points of the longest prefix within ``budget`` tokens, from a stored column."""

    @F.pandas_udf(LongType())
    def cut(s: pd.Series) -> pd.Series:
        return pd.Series([_within(read_counts(blob), budget) for blob in s], dtype="int64")

    return cut(stored)


def _within(counts: np.ndarray, budget: int) -> int:
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``limit_chars`` (code points of the longest prefix within ``limit``).

    One pass counts the whole chunks, and the prefixes of the chunk that passes the limit. A null text is
    empty. Rows are independent: repeated rows stay, an empty table stays empty, and columns with
    the names of results are replaced.
    """
    schema = StructType([StructField(c, LongType()) for c in ("n_bytes", "n_tokens", "limit_chars")])

    @F.pandas_udf(schema)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(path, _MADE)
        for texts in batches:
            rows = []
            for t in texts:
                rows.append((len(t.encode()), *counter.text_total(t, limit)) if t else (0, 0, 0))
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 3), columns=["n_bytes", "n_tokens", "limit_chars"])

    new = {"n_bytes", "n_tokens", "over_limit", "limit_chars"}
    keep = [c for c in docs.columns if c not in new]
    return docs.withColumn("_counted", count.asNondeterministic()("text")).select(
        *keep, "_counted.n_bytes", "_counted.n_tokens", (F.col("_counted.n_tokens") > limit).alias("over_limit"), "_counted.limit_chars"
    )
