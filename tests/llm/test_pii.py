"""Base spans against the plain patterns, and what weak supervision adds."""

import hashlib
import random
import re

from helpers import docs, prose
from winnow.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


PARTS = ["a.b", "@", "x-y", ".", "com", "1", "23", "255", "256", "0", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0100", "+", " ", "-", "(", ")", "é", "10.0.0.1", "999", "0001", "中", "\n", "_", "%", "5500000000000004", "bob@mail.example.org"]


def test_base_spans():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        assert sorted(P.base_spans(t)) == brute(t), repr(t)


def test_long_runs_are_fast():
    for t in ["1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000, "a.b@c." * 30_000]:
        P.base_spans(t)


def test_columns(spark):
    texts = [None, "", prose(50, 1), "mail ann@example.com or call +1 (212) 555-0100, ip 10.1.2.3 card 4111 1111 1111 1111", "é 中 joe.x@mail.example.org"]
    out = {r.doc_id: r for r in P.find_personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in brute(t or ""))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and out[i].spans.startswith(base)
    assert (out[3].n_email, out[3].n_ip, out[3].n_card, out[3].n_phone) == (1, 1, 1, 1)
    assert P.masked(texts[3], out[3].spans) == "mail [email] or call [phone], ip [ip] card [card]"


def test_weak_supervision_adds_and_refuses(spark):
    good = [f"please call me: phone ({200 + i % 9 * 90}) 555-01{i:02d} today" for i in range(40)]
    spelled = [f"my email is bob{i} [at] mail.example.com thanks" for i in range(40)]
    bad = [f"see order version {100 + i}-{1000 + i}-{2000 + i}/x7 page" for i in range(60)]
    base = [f"email ann{i}@example.com phone +1 (212) 555-01{i:02d}" for i in range(40)]
    out = {r.doc_id: r for r in P.find_personal_data(docs(spark, good + spelled + bad + base)).collect()}
    hits = lambda a, b, k: sum(k in out[i].spans for i in range(a, b))
    assert hits(0, 40, "phone") >= 36 and hits(40, 80, "email") >= 36 and hits(80, 140, "phone") == 0 and hits(140, 180, "email") == 40


def test_em_finds_the_reliable_labeler():
    import numpy as np

    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.4
    right = [0.95, 0.9, 0.6, 0.85, 0.55]
    votes = np.array([[(1 if y else -1) * (1 if r.random() < p else -1) for p in right] for y in truth])
    post, rel, prior = P.label_posteriors(np.zeros(4000, int), votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95 and abs(prior[0] - 0.4) < 0.05 and rel[0, 1, 0, 2] > rel[0, 1, 2, 2] > rel[0, 1, 4, 2] - 0.05


def test_odd_tables(spark):
    d = docs(spark, ["a@b.cd"] * 2).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "1 AS spans", "2 AS n_ip")
    assert [(r.n_email, r.spans) for r in P.find_personal_data(d).collect()] == [(1, "email:0:6")] * 2
    assert P.find_personal_data(docs(spark, [])).count() == 0 and P.find_personal_data(docs(spark, [None])).first().spans == ""


def test_many_proposals_in_one_text():
    """Loose spans are held against those taken so far, however many there are."""
    import time

    text = " ".join(f"call 415-555-{i % 10000:04d} or x{i}@mail{i}.example now" for i in range(20000))
    start = time.time()
    found = P.proposals(text, P.base_spans(text))
    assert len(found) >= 40000 and time.time() - start < 20
    spans = sorted((a, b) for _, a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
