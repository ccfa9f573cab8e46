"""SentencePiece encoding and decoding with a unigram model.

A text becomes a string of pieces with the greatest sum of log scores (Viterbi), found over a
double-array trie of the pieces. Spaces are written as a marker inside pieces; characters that no piece
holds are written as their UTF-8 bytes. Pieces and scores come from a ``sentencepiece`` model file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

MARK = "▁"
#: Entries of a task's memo of chunks; it starts anew when full.
MEMO = 400_000
#: Entries from which it starts anew between texts, so that it does not in the midst of them.
MOST_LEARNT = 300_000
KEPT_CHARS = 40
#: Words of up to this many bytes are encoded many at a time, so many together.
MANY_BYTES, MANY = 48, 1 << 13
#: Characters of the texts whose unknown words are encoded together, if not one text alone has more.
TOGETHER = 1 << 20
#: Documents whose results leave a task together.
SLICE = 500
#: Fixed value: how much worse than the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie in two arrays: the child of node ``s`` for byte ``c`` is ``base[s] + c``, if ``check`` names ``s`` there."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in zip(keys, values):
            node = 0
            for c in key:
                nxt = tree[node].get(c)
                if nxt is None:
                    nxt = tree[node][c] = len(tree)
                    tree.append({})
                node = nxt
            ends[node] = value
        size = 2 * len(tree) + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        check[0] = 0
        place, todo = {0: 0}, [0]
        low = [1, 1]  # where the search begins for nodes with one child and with more
        for node in todo:  # parents before children
            at = place[node]
            value[at] = ends.get(node, -1)
            codes = sorted(tree[node])
            if not codes:
                continue
            many = len(codes) > 1
            b = first = max(1, low[many] - codes[0])
            while any(used[b + c] for c in codes):
                b += 1
                if b + 256 >= len(used):
                    grow = len(used)
                    used += bytearray(grow)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
            if b - first > (64 if many else 0):  # what lies before is nearly full
                low[many] = b + codes[0]
            base[at] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = at
                place[tree[node][c]] = b + c
                todo.append(tree[node][c])
        last = max(place.values()) + 257
        self.base, self.check, self.value = (np.array(x[:last] + [fill] * (last - len(x[:last])), np.int32) for x, fill in ((base, 0), (check, -1), (value, -1)))


@dataclass
class PieceModel:
    """What encoding and decoding need of a model; its size is that of the vocabulary."""

    trie: DoubleArray
    scores: np.ndarray
    texts: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    dummy_prefix: bool
    split: str
    end_id: int = 2
    by_words: bool = True

    @staticmethod
    def load(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave their input as it is are supported")
        kind = pb.ModelProto.SentencePiece
        keys, ids, byte_ids, texts = [], [], [-1] * 256, []
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                texts.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                keys.append(p.piece.encode())
                ids.append(i)
                texts.append(p.piece.replace(MARK, " ").encode())
            else:
                texts.append(b"")
        normal = [p.piece for p in proto.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)]
        whole = any(MARK in p.lstrip(MARK) for p in normal)  # then no border is safe
        lines = not any("\n" in p for p in normal)
        split = "(?s).+" if whole else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lines else f"(?s){MARK}*[^{MARK}]+|{MARK}+"
        scores = np.array([p.score for p in proto.pieces], np.float64)
        return PieceModel(DoubleArray(keys, ids), scores, texts, byte_ids, proto.trainer_spec.unk_id, norm.add_dummy_prefix, split, proto.trainer_spec.eos_id, lines and not whole)


class _Memo(dict):
    """From a word to its piece ids as ``<i4`` bytes; ``prefix`` stands before the word."""

    def __init__(self, encoder: Encoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encoder.viterbi((self.prefix + word).encode()), "<i4").tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= KEPT_CHARS:
            self[word] = out
        return out


class Encoder:
    """Encodes whole texts chunk by chunk: no piece crosses the border of two chunks."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.base, self.check, self.value = (x.tolist() for x in (model.trie.base, model.trie.check, model.trie.value))
        self.scores = model.scores.tolist()
        self.unknown = min(self.scores[i] for i in self.value if i >= 0) - UNKNOWN_PENALTY
        self.chunks = re.compile(model.split).findall
        self.marked, self.bare = _Memo(self, MARK), _Memo(self, "")

    def viterbi(self, data: bytes) -> list[int]:
        """Ids of the best path. Of equal paths the one whose last piece begins first wins."""
        n = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            c = data[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            node, single = 0, False
            for j in range(i, n):
                nxt = base[node] + data[j]
                if check[nxt] != node or nxt == 0:
                    break
                node = nxt
                piece = value[node]
                if piece >= 0:
                    e = j + 1
                    single = single or e == i + width
                    total = here + scores[piece]
                    if best[e] is None or total > best[e]:
                        best[e], back[e] = total, (i, piece)
            if not single:
                e, total = i + width, here + self.unknown
                if best[e] is None or total > best[e]:
                    best[e], back[e] = total, (i, -1)
        out, e = [], n
        while e:
            i, piece = back[e]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.model.byte_ids[b] if self.model.byte_ids[b] >= 0 else self.model.unknown_id for b in reversed(data[i:e])]
            e = i
        return out[::-1]

    def viterbi_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as ``<i4`` bytes: ``viterbi`` for many words in step, position by position."""
        base, check, value, scores = self.model.trie.base, self.model.trie.check, self.model.trie.value, self.model.scores
        lens = np.array([len(w) for w in words])
        m, longest = len(words), int(lens.max())
        data = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(m, longest).T.astype(np.int32)
        best = np.full((longest + 1, m), -np.inf)
        back, piece = np.zeros((longest + 1, m), np.int32), np.full((longest + 1, m), -1, np.int32)
        best[0] = 0.0
        for i in range(longest):
            start = np.flatnonzero((best[i] > -np.inf) & (lens > i))
            here, c = best[i, start], data[i, start]
            width = 1 + (c >= 0x80) + (c >= 0xE0) + (c >= 0xF0)
            single = np.zeros(len(start), bool)
            at, row, node = np.arange(len(start)), start, np.zeros(len(start), np.int32)
            for j in range(i, longest):
                step = base[node] + data[j, row]
                ok = (check[step] == node) & (step != 0) & (lens[row] > j)
                at, row, node = at[ok], row[ok], step[ok]
                if not len(at):
                    break
                found = value[node]
                ends = np.flatnonzero(found >= 0)
                k, r, found = at[ends], row[ends], found[ends]
                single[k] |= width[k] == j + 1 - i
                total = here[k] + scores[found]
                more = total > best[j + 1, r]
                r = r[more]
                best[j + 1, r], back[j + 1, r], piece[j + 1, r] = total[more], i, found[more]
            none = np.flatnonzero(~single)
            e, r, total = i + width[none], start[none], here[none] + self.unknown
            more = total > best[e, r]
            e, r = e[more], r[more]
            best[e, r], back[e, r], piece[e, r] = total[more], i, -1
        out, n = np.zeros((m, longest), "<i4"), np.zeros(m, np.int64)
        row, e, odd = np.arange(m), lens, np.zeros(m, bool)
        while len(row):  # from the last piece to the first, so the ids stand at the right
            got = piece[e, row]
            odd[row] |= got < 0
            n[row] += 1
            out[row, longest - n[row]] = got
            e = back[e, row]
            row, e = row[e > 0], e[e > 0]
        flat = out[np.arange(longest) >= (longest - n)[:, None]].tobytes()
        cuts = np.concatenate([[0], 4 * np.cumsum(n)]).tolist()
        found = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(odd).tolist():  # characters without a piece
            found[k] = np.array(self.viterbi(words[k]), "<i4").tobytes()
        return found

    def learn(self, texts: list[str]) -> None:
        """Put the words of ``texts`` that the memos lack into them."""
        marked, bare = set(), set()
        for text in texts:
            for line in text.split("\n"):
                words = line.split(" ")
                bare.add(words[0])
                marked.update(words)
        for memo, words in ((self.marked, marked), (self.bare, bare)):
            if len(memo) >= MOST_LEARNT:
                memo.clear()
            new = [w for w in words - memo.keys() if 0 < len(w) <= KEPT_CHARS]
            coded = sorted((x for x in (((memo.prefix + w).encode(), w) for w in new) if len(x[0]) <= MANY_BYTES), key=lambda x: len(x[0]))
            for a in range(0, len(coded), MANY):
                part = coded[a : a + MANY]
                memo.update(zip((w for _, w in part), self.viterbi_many([b for b, _ in part])))

    def encode_many(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """``encode`` of each text; the unknown words of some texts are encoded together."""
        held, n = [], 0
        for text in texts:
            held.append(text)
            n += len(text)
            if n >= TOGETHER:
                self.learn(held) if self.model.by_words else None
                yield from map(self.encode, held)
                held, n = [], 0
        if held:
            self.learn(held) if self.model.by_words else None
            yield from map(self.encode, held)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        marked, bare, out = self.marked.__getitem__, self.bare.__getitem__, []
        if not self.model.by_words:
            out += map(bare, self.chunks((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)))
            return np.frombuffer(b"".join(out), "<i4")
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(bare("\n"))
            words = line.split(" ")
            start = not k and self.model.dummy_prefix
            if "" in words:  # runs of spaces, which are chunks with the word after them
                out += map(bare, self.chunks((MARK if start else "") + line.replace(" ", MARK)))
            else:
                out.append((marked if start else bare)(words[0]))
                out += map(marked, words[1:])
        return np.frombuffer(b"".join(out), "<i4")


def decode_ids(ids, model: PieceModel) -> str:
    """The text of a list of ids; the marker that encoding put first goes. Bytes that are not UTF-8 become U+FFFD."""
    raw = b"".join(map(model.texts.__getitem__, ids))
    if model.dummy_prefix and raw.startswith(b" "):
        raw = raw[1:]
    return raw.decode(errors="replace")


_LOADED: dict[str, PieceModel] = {}  # of the driver
_ENCODERS: dict[object, Encoder] = {}  # of a worker, by broadcast


def shared_model(docs: DataFrame, path: str):
    """The model as a broadcast; it is as large as the vocabulary and does not grow with the data."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel.load(path)
    return docs.sparkSession.sparkContext.broadcast(_LOADED[path])


def encoder_of(shared) -> Encoder:
    """One encoder for all tasks of a worker that use the same broadcast."""
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encoded(text: Column | str, shared) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder_of(shared)
        for texts in batches:
            for a in range(0, len(texts), SLICE):
                yield pd.Series([None if t is None else e.encode(t) for t in texts.iloc[a : a + SLICE]], dtype=object)

    return encode.asNondeterministic()(text)


def decoded(ids: Column | str, shared) -> Column:
    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for lists in batches:
            yield pd.Series([None if x is None else decode_ids(x.tolist(), model) for x in lists], dtype=object)

    return decode.asNondeterministic()(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``: the piece ids of each whole text, null for a null text, none for an empty one.

    Rows are independent: repeated rows stay and an empty table stays empty; a column ``ids`` is replaced.
    """
    return docs.withColumn("ids", encoded("text", shared_model(docs, path)))


def decode_documents(docs: DataFrame, path: str, out: str = "text") -> DataFrame:
    """``docs`` with the column ``out`` decoded from ``ids``."""
    return docs.withColumn(out, decoded("ids", shared_model(docs, path)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, ``n_pieces``, ``n_byte_pieces`` and ``exact``, which says whether decoding gives the text back.

    Only a text that itself holds the marker (U+2581) is not given back: the marker becomes a space.
    Null texts have null results; columns with the names of results are replaced.
    """
    shared = shared_model(docs, path)
    new = StructType([StructField("ids", ArrayType(IntegerType())), StructField("n_pieces", LongType()), StructField("n_byte_pieces", LongType()), StructField("exact", BooleanType())])

    @F.pandas_udf(new)
    def both_ways(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder_of(shared)
        in_bytes = np.zeros(len(e.model.texts), bool)
        in_bytes[[i for i in e.model.byte_ids if i >= 0]] = True
        for texts in batches:
            for a in range(0, len(texts), SLICE):
                rows = []
                for t in texts.iloc[a : a + SLICE]:
                    if t is None:
                        rows.append((None, None, None, None))
                    else:
                        ids = e.encode(t)
                        rows.append((ids, len(ids), int(in_bytes[ids].sum()), decode_ids(ids.tolist(), e.model) == t))
                out = pd.DataFrame(rows, columns=new.fieldNames())
                yield out.astype({"n_pieces": "Int64", "n_byte_pieces": "Int64", "exact": "boolean"})

    keep = [c for c in docs.columns if c not in new.fieldNames()]
    return docs.withColumn("_both", both_ways.asNondeterministic()("text")).select(*keep, "_both.*")
