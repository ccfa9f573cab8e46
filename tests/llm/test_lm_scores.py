"""Counts, base scores and the model against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import docs, prose
from winnow.llm import lm_scores as M


def toks(t):
    return [*(w.decode() for w in M.lower_words(t)), None]


def brute(texts):
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in toks(t))
    n, v = sum(c.values()), len(c)
    return c, n, v, [(zlib.crc32(str(i).encode()) % 7 == 2, len(toks(t)), sum(c[w] > 0 for w in toks(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_base(spark, head):
    texts = [None, "", "Only HERE once", "x " * 3000] + [prose(60 + i, i) for i in range(40)] + ["a\x1cb", "ÉA éa"]
    _, n, _, want = brute(texts)
    out = {r.doc_id: r for r in M.scores(docs(spark, texts).drop("n_chars"), M.Settings(head=head, max_filter_bits=1 << 20)).collect()}
    for i, (held, size, known, base) in enumerate(want):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_model_probabilities(spark):
    """Without false positives the score follows from quantised counts; on text like the training text it beats the words alone."""
    texts = [prose(300, i % 9) for i in range(60)]
    out = {r.doc_id: r for r in M.scores(docs(spark, texts)).collect()}
    c, n, v, _ = brute(texts)
    pairs = Counter(p for i, t in enumerate(texts) if not out[i].held_out for p in zip([None, *toks(t)], toks(t)))
    b = M.level_borders(M.Settings().base)
    low = lambda x: 0 if not x else int(b[np.searchsorted(b, x, side="right") - 1])
    high = lambda x: 0 if not x else int(b[np.searchsorted(b, x, side="right")]) - 1
    held = [i for i in out if out[i].held_out]
    for i in held[:5]:
        t = toks(texts[i])
        want = sum(math.log10((low(pairs[p]) + 500 * (low(c[p[1]]) + 1) / (n + v + 1)) / (high(c[p[0]]) + 500)) for p in zip([None, *t], t))
        assert abs(out[i].score - want) < 0.02 * abs(want)
    assert sum(out[i].score for i in held) > sum(out[i].base_score for i in held)


def test_a_large_filter_is_probed_by_ranges(spark, monkeypatch):
    """A filter that is not broadcast gives the same scores: all n-grams stay, whatever the size. Several parts and groups."""
    monkeypatch.setattr(M, "HELD", 2)
    monkeypatch.setattr(M, "ASKING", 300)
    texts = [None, "", "Only HERE once", "x " * 3000] + [prose(200, i) for i in range(30)]
    d = docs(spark, texts).unionByName(docs(spark, texts[-2:]))
    rows = [sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in M.scores(d, M.Settings(max_filter_bits=n)).collect()) for n in (1 << 29, 0)]
    assert len(rows[0]) == len(texts) + 2 and rows[0] == rows[1]
    assert M.scores(docs(spark, []), M.Settings(max_filter_bits=0)).count() == 0


def test_odd_tables(spark):
    assert M.scores(docs(spark, [])).count() == 0
    d = docs(spark, ["a b"] * 2).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "1 AS row", "2 AS word")
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in M.scores(d).collect()] == [(3, 3, 6)] * 2


def test_groups_keep_tokens_once_and_short(spark):
    """Groups kept a hash of eight bytes for each token, twice; now a place among their distinct words, in one row."""
    texts = [prose(4000, i) for i in range(12)]
    d = docs(spark, texts)
    model = M.train(d.select("text"), M.Settings(max_filter_bits=0))
    rows = M._grouped(d, model).collect()
    groups = [r for r in rows if r["first"] is not None]
    n = sum(r.n_tokens for r in rows if r["first"] is None)
    assert len(rows) == len(texts) + len(groups) and n == sum(len(M.token_hashes(t, M.WordHashes())) for t in texts)
    assert sum(len(g.words) + len(g.places) for g in groups) < 3 * n


def test_groups_share_their_probes(spark, monkeypatch):
    """Each group's n-grams were probed apart; groups that are answered together give the same scores."""
    monkeypatch.setattr(M, "ASKING", 200)
    d = docs(spark, [prose(150, i % 4) for i in range(20)])
    got = []
    for n in (1, 1 << 18):
        monkeypatch.setattr(M, "ANSWERED", n)
        got.append(sorted((r.doc_id, r.score) for r in M.scores(d, M.Settings(max_filter_bits=0)).collect()))
    assert got[0] == got[1]
