"""Runs against all periods of all stretches, and the digests of the query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from helpers import docs, prose
from winnow.llm import periodic_runs as P


def brute(words, least):
    """For each period the maximal stretches of places that equal the one a period on; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def check(words, least):
    assert [tuple(r) for r in P.word_runs(words, least).tolist()] == brute(words, least), (words, least)


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_random_words(least):
    r = random.Random(least)
    for k in range(400):
        n = r.randint(0, 70)
        words = [r.choice("abcdef"[: 1 + k % 6]) for _ in range(n)]
        if k % 3 == 0 and n:  # a period and a few changed words
            a, p = r.randrange(n), r.randint(1, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] if a + (i - a) % p < n else words[i] for i in range(n)]
            for _ in range(r.randint(0, 2)):
                words[r.randrange(n)] = r.choice("abcdefg")
        check(words, least)


def test_special_words():
    fib = ["a", "b"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    for words in ("a" * 300, "ab" * 200 + "c", fib[-1], "abcabcabcabdabdabdabd" * 4, "a" * 40 + "b" + "a" * 40):
        check(list(words), 12)


def test_extensions_against_comparison():
    r = random.Random(5)
    ids = [r.randint(1, 2) for _ in range(200)]
    e = P.Extensions(*P.SuffixTree(ids).tour())
    i, j = np.array([(i, j) for i in range(200) for j in range(201) if i != j]).T

    def common(a, b):
        k = 0
        while max(a, b) + k < 200 and ids[a + k] == ids[b + k]:
            k += 1
        return k

    assert e(i, j).tolist() == [common(a, b) for a, b in zip(i, j)]


def test_query_digests(spark):
    texts = [None, "", " \t\n", "x", "a b c " * 30, prose(400, 1), prose(30, 2) + " " + "q r s t " * 9 + prose(30, 3), "eins zwei " * 8 + "drei"] + [prose(90, k) for k in range(40)]
    table = docs(spark, texts, first=100)
    out = {r.doc_id: r for r in P.run_digests(P.periodic_runs(P.repeated_tails(table))).collect()}
    assert len(out) == len(texts) and out[104].period == 3
    planted = 0
    for k, text in enumerate(texts):
        doc_id = 100 + k
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words, 12)
        row = out[doc_id]
        assert row.n_runs == len(runs)
        if runs:
            s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest() and row.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert planted >= 2


def test_odd_tables(spark):
    d = docs(spark, ["a b " * 20] * 2 + [None]).selectExpr("IF(doc_id = 2, NULL, doc_id) AS doc_id", "text", "1 AS n_words", "'x' AS runs", "2 AS collapsed_text", "3 AS _word")
    out = P.periodic_runs(P.repeated_tails(d))
    assert out.count() == 3 and sorted(out.columns) == ["_word", "collapsed_text", "doc_id", "n_words", "runs", "text"]
    assert P.run_digests(out).filter("n_runs = 1").count() == 2
    assert P.run_digests(P.periodic_runs(docs(spark, []))).count() == 0


def test_long_text(spark):
    text = prose(60000, 7) + " " + (prose(20000, 8) + " ") * 2
    r = P.periodic_runs(docs(spark, [text])).first()
    assert r.n_words == 100000 and max(x.period for x in r.runs) == 20000
