"""Line rules, counts and verdicts."""

import re
from collections import Counter

from helpers import docs, prose
from winnow.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_counts_against_brute_force(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a a a a", "x y z x y z q", "one\ntwo\none\n\n\none", "a\x1cb\xa0c d", "é ü 中文 # * $ | <b>", prose(3000, 1), "w " * 20000, "l\n" * 5000, "\x85 \x1f"]
    out = {r.doc_id: r for r in Q.quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), (i, t and t[:40])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_lines(spark):
    R = Q.DEFAULT_RULES
    n = lambda s: len(s.split())
    bad = ["Home | About us | Products | Contact", "Accept all cookies to go on.", "Read more", "word*** other&&& third%%% $$$ #", "BUY!! NOW!! CHEAP!! OFFER!!", "Terms of service apply here."]
    good = ["This is a plain sentence that ends well.", "", "   ", "Short but ended.", "a line that was wrapped by an editor at eighty columns and so has no end", "«Une phrase.»", "これは文です。"]
    assert all(R.fails(x, n(x)) for x in bad) and not any(R.fails(x, n(x)) for x in good)


def test_verdict_and_cleaning(spark):
    body = prose(200, 2)
    junk = "\n".join(["Home | About | News | Contact"] * 3)
    mostly_junk = prose(60, 3) + "\n" + "\n".join(f"Alpha{i} | Beta{i} | Gamma{i} | Delta{i} | Epsilon{i}" for i in range(60))
    d = docs(spark, [body + "\n" + junk, mostly_junk, "too short.", None, body])
    kept = {r.doc_id: r for r in Q.clean_documents(d).collect()}
    assert set(kept) == {0, 4} and kept[0].text.strip() == body.strip() and kept[0].n_chars == len(kept[0].text)
    assert Q.clean_documents(d).columns == d.columns


def test_odd_tables(spark):
    d = docs(spark, [prose(100, 4)] * 2).selectExpr("doc_id", "text", "1 AS n_words", "'x' AS kept", "2 AS clean_text")
    out = Q.quality(d)
    assert out.count() == 2 and sorted(out.columns) == sorted({*out.columns}) and out.first().n_words == 100
    empty = docs(spark, [])
    assert Q.quality(empty).count() == 0 and Q.clean_documents(empty).count() == 0
