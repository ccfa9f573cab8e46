"""Unigram encoding against all segmentations and the library's unigram model with the same pieces, and round trips."""

import random

import public_tokenizers as P
import pytest
import sentencepiece as sp
from helpers import docs, prose
from winnow.llm import pieces as X

PATH = P.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", " ", "  ", "    ", "\n", "é", "中文", "1", "23", "!!", "...", "\xa0", "\x1c", "ñ", "🙂", "T", "hello", "world", "\t", "한국", "\x00"]


@pytest.fixture(scope="module")
def encoder():
    return X.Encoder(X.PieceModel.load(PATH))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    return sp.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_never_below_the_library(encoder, library):
    """The library adds in single precision; no segmentation that it finds may have a greater sum."""
    r = random.Random(5)
    known = ["a", "the", "ing", " ", "é", "1", "23", "!!", "...", "ñ", "T", "hello", "world", "ation", "sch", "ü", "de "]
    score, same = encoder.scores, 0
    for _ in range(1500):
        t = "".join(r.choice(known) for _ in range(r.randint(0, 12)))
        ids, theirs = encoder.encode(t).tolist(), library.encode(t)
        assert sum(score[i] for i in ids) >= sum(score[i] for i in theirs), repr(t)
        same += ids == theirs
    assert same > 1300


def test_best_of_all_segmentations(encoder):
    m = encoder.model
    score = {t: m.scores[i] for i, t in enumerate(m.texts) if i not in set(m.byte_ids) and t}

    def best(text):
        if not text:
            return 0.0
        return max(((score.get(text[:k].replace("▁", " ").encode(), None if k > 1 else encoder.unknown) or -1e300) + best(text[k:]) for k in range(1, len(text) + 1)), default=0.0)

    r = random.Random(6)
    for _ in range(60):
        t = "".join(r.choice("thenigas🙂é") for _ in range(r.randint(1, 9)))
        ids = encoder.viterbi(("▁" + t).encode())
        got, known_bytes = 0.0, set(m.byte_ids)
        run = b""
        for i in ids:
            if i in known_bytes:
                run += m.texts[i]
                continue
            got += m.scores[i]
        got += encoder.unknown * len(run.decode())
        assert abs(got - best("▁" + t)) < 1e-3, t


def test_round_trip(spark):
    r = random.Random(4)
    texts = [None, "", " ", "  two  spaces ", prose(5000, 8), "中" * 4000, "x" * 20000, "\n\n\t", "mark ▁ lost"] + ["".join(r.choice(PARTS) for _ in range(30)) for _ in range(100)]
    out = {x.doc_id: x for x in X.round_trip(docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert out[i].exact is (None if t is None else "▁" not in t), (i, t)
        assert out[i].n_pieces == (None if t is None else len(out[i].ids))
    back = X.decode_documents(X.encode_documents(docs(spark, texts), PATH), PATH, "back").filter("NOT back <=> text").collect()
    assert [x.doc_id for x in back] == [8]


def test_odd_tables(spark):
    d = docs(spark, ["a b"] * 2).selectExpr("doc_id", "text", "'x' AS ids", "1 AS exact")
    out = X.round_trip(d, PATH)
    assert out.count() == 2 and len(set(out.columns)) == len(out.columns)
    assert X.round_trip(docs(spark, []), PATH).count() == 0


def test_many_words_in_step():
    """Each unknown word was worked out alone; now those of many texts are, position by position, with the same ids."""
    r = random.Random(5)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "中文", "🙂", "\x00", "▁", "!!", "12", "tion", "\U000e0001", "x" * 60, "\xa0"]
    texts = ["", "a", "\n", " "] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(500)]
    model = X.PieceModel.load(PATH)
    alone, many = X.Encoder(model), X.Encoder(model)
    for got, text in zip(many.encode_many(texts), texts, strict=True):
        assert got.tolist() == alone.encode(text).tolist(), repr(text)
    plain = ["some words that tokenizers split, and others they keep whole"] * 3
    one = X.Encoder(model)
    one.viterbi = None  # not needed for ordinary words
    assert [x.tolist() for x in one.encode_many(plain)] == [alone.encode(x).tolist() for x in plain]
