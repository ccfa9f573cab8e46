"""Counts at every prefix against the library."""

import random

import public_tokenizers as P
import pytest
from helpers import docs, prose
from tokenizers import Tokenizer
from winnow.llm import token_counts as T

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


PARTS = ["a", "b", "the", "ing", " ", "\n", "'", "'s", "'RE", "'ve", "<|endoftext|>", "<|startoftext|>", "<|", "é", "é", "İ", "ß", "Σ", "中文", "1", "23", "!!", "...", "\xa0", "\x1c", "\x85", "ñ", "ſ", "≮", "🙂", "T", "'l", "'ll", "aaaa", "sss"]


def test_every_prefix(library):
    r = random.Random(7)
    counter = T.PrefixCounter(PATH)
    for _ in range(400):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(1, 12)))
        want = [size(library, t[: i + 1]) for i in range(len(t))]
        assert list(counter.text_counts(t)) == want, repr(t)


def test_words_share_their_beginnings(library):
    """Each word was worked out from its first letter; now only what follows the longest beginning that was met before."""

    class Looked(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    counter = T.PrefixCounter(PATH)
    counter.both = Looked(counter.both)
    looked = []
    for word in ("thandertion", "thandertions", "thander", "thandertiox", "thandertion", "überthander", "überthandes"):
        before = counter.both.n
        counts = list(counter.piece_counts(word))
        looked.append(counter.both.n - before)
        assert counts == [size(library, word[: i + 1]) for i in range(len(word))]
    assert looked[2] <= looked[0] and looked[4] == 0 and looked[1] < looked[0] / 2 and looked[3] < looked[0] / 2 and looked[6] < looked[5] / 2


def test_query_and_store(spark, library):
    texts = [None, "", "   ", "Hello world", prose(4000, 5), "x" * 3000, "a'b-" * 500, "ein\tÄrger\x0bübt", "<|endoftext|>" * 3, "don't<|endoftext|>stop"]
    out = {r.doc_id: r for r in T.token_counts(docs(spark, texts), PATH, limit=100).collect()}
    stored = docs(spark, texts).withColumn("p", T.prefix_counts("text", PATH)).selectExpr("*")
    answers = {r.doc_id: r for r in stored.select("doc_id", T.counts_at("p", "doc_id").alias("at"), T.longest_prefix("p", 100).alias("cut")).collect()}
    for i, t in enumerate(texts):
        assert (out[i].n_bytes, out[i].n_tokens) == (len((t or "").encode()), size(library, t or "")), i
        assert out[i].over_limit == (out[i].n_tokens > 100)
        cut = out[i].limit_chars
        assert cut == answers[i].cut and size(library, (t or "")[:cut]) <= 100
        assert cut == len(t or "") or all(size(library, t[:k]) > 100 for k in range(cut + 1, min(len(t), cut + 40)))
        assert answers[i].at == size(library, (t or "")[:i])


def test_odd_tables(spark):
    d = docs(spark, ["a b", "a b"]).selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS over_limit")
    out = T.token_counts(d, PATH)
    assert [r.n_tokens for r in out.collect()] == [2, 2] and len(out.columns) == len(set(out.columns))
    assert T.token_counts(docs(spark, []), PATH).count() == 0


def test_whole_texts_without_the_counts_in_between(library):
    """Every prefix of every chunk was counted, though only the chunk that passes the limit needs it."""
    r = random.Random(11)
    counter, every = T.PrefixCounter(PATH), T.PrefixCounter(PATH)
    for _ in range(300):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(1, 12)))
        counts = every.text_counts(t)
        for limit in (-1, 0, 1, 4, 50):
            assert counter.text_total(t, limit) == (size(library, t), T._within(counts, limit)), repr(t)
    counter = T.PrefixCounter(PATH)
    text = prose(3000, 3)
    assert counter.text_total(text, 10**9) == (size(library, text), len(text))
    assert not counter and not counter.prefixes
