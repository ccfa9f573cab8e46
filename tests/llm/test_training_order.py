"""The permutation, and the shards against the packed tokens."""

import os
import tempfile

import numpy as np
import public_tokenizers as P
import pytest
from helpers import docs, prose
from winnow.llm import pieces
from winnow.llm import training_order as T

PATH = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_bijection(n):
    for key in (0, 1, 2**70 + 3):
        slots = T.permute(np.arange(n), n, key)
        assert sorted(slots) == list(range(n)) and (T.unpermute(slots, n, key) == np.arange(n)).all()
    assert n < 100 or (T.permute(np.arange(n), n, 1) != T.permute(np.arange(n), n, 2)).mean() > 0.9


def test_shards(spark):
    lay = T.Layout(length=32, per_shard=10, key=5)
    texts = [prose(70 + 13 * i, i) for i in range(30)] + [None, "", "short"]
    folder = tempfile.mkdtemp(prefix="spark-")
    d = docs(spark, texts).coalesce(1)
    rows = sorted(T.write_shards(d, PATH, folder, lay).collect())
    enc = pieces.Encoder(pieces.PieceModel.load(PATH))
    stream = np.concatenate([np.append(enc.encode(t), 2) for t in texts if t])
    n = -(-len(stream) // 32)
    padded = np.concatenate([stream, np.zeros(n * 32 - len(stream), int)]).reshape(n, 32)
    assert [r.slot for r in rows] == list(range(n)) and sum(r.n_tokens for r in rows) == len(stream)
    assert (T.read_records(folder, 0, n) == padded[T.unpermute(np.arange(n), n, 5)]).all()
    assert (T.read_records(folder, 7, 9) == T.read_records(folder, 0, n)[7:16]).all() and len(T.read_records(folder, n, 5)) == 0
    assert all((r.shard, r.offset) == (r.slot // 10, r.slot % 10 * 64) for r in rows)
    assert {i for r in rows for i in r.doc_ids} == {*range(30), 32}
    assert sorted(f for f in os.listdir(folder) if f.endswith(".bin")) == [f"shard-{i:08d}.bin" for i in range(-(-n // 10))]


def test_partitions_and_odd_tables(spark):
    lay = T.Layout(length=16, per_shard=8)
    d = docs(spark, [prose(50, i) for i in range(12)]).repartition(4).selectExpr("doc_id", "text", "1 AS slot", "2 AS part")
    rows = sorted(T.training_order(d, PATH, lay).collect())
    assert [r.slot for r in rows] == list(range(len(rows))) and {i for r in rows for i in r.doc_ids} == set(range(12))
    twice = docs(spark, ["a b c"] * 2).selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert [r.doc_ids for r in T.training_order(twice.coalesce(1), PATH, lay).collect()] == [[None]]
    assert T.training_order(docs(spark, []), PATH, lay).count() == 0
