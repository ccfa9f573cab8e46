"""Near duplicates against all pairs."""

import random

from helpers import docs, prose
from winnow.llm import near_dedup as N


def shingles(text):
    w = [x.decode() for x in N.lower_words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


def edited(text, r, n):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    r = random.Random(3)
    texts = [None, "", " \n", "one two", "One TWO", "one two three", "a b c d e", "A b c d e"]
    for k in range(12):
        base = prose(r.choice([30, 120, 400, 900]), 100 + k)
        texts += [base, base.upper(), edited(base, r, 1), edited(base, r, 2), edited(base, r, len(base.split()) // 60), edited(base, r, len(base.split()) // 25)]
    chain = prose(300, 77)
    for _ in range(25):  # neighbours are similar, the ends are not
        chain = edited(chain, r, 2)
        texts.append(chain)
    hot = prose(250, 78)
    texts += [edited(hot, r, r.randrange(8)) for _ in range(60)]
    r.shuffle(texts)
    out = sorted(tuple(x) for x in N.near_duplicates(docs(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert out == brute(texts)
    kept = {x.doc_id for x in N.unique_documents(docs(spark, texts)).collect()}
    assert kept == {i for i, _, _, k in brute(texts) if k}


def test_buckets_are_complete():
    """A pair at the threshold shares a table key with a probability of at least 0.998."""
    p = 0.85**N.ROWS
    assert (1 - (1 - p) ** N.SIDE) ** 2 > 0.998


def test_odd_tables(spark):
    d = docs(spark, ["same text here", "same text here", None, "other words"]).selectExpr("IF(doc_id = 3, NULL, doc_id) AS doc_id", "text", "'x' AS node", "1 AS kept", "2 AS component_id")
    out = N.near_duplicates(d)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (None, 1, None, True)]))
    kept = N.unique_documents(d.unionByName(d))
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "None", "None"]
    assert N.near_duplicates(docs(spark, [])).count() == 0 and N.unique_documents(docs(spark, [])).count() == 0


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    """Copies with edits of their own, of which many are linked with nothing, are not compared pair by pair."""
    r = random.Random(5)
    base = prose(150, 81)
    texts = [edited(base, r, r.randrange(1, 7)) for _ in range(300)]
    compared, compare = [], N.compare

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return compare(pairs, sets, percent)

    monkeypatch.setattr(N, "compare", counted)
    out = sorted(tuple(x) for x in N.near_duplicates(docs(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert out == brute(texts) and 60 < sum(not k for *_, k in out) < 240
    assert sum(compared) < 20 * len(texts), compared  # all pairs: 44,850


def test_links_of_sets_with_only_shared_rare_shingles(spark):
    """Texts whose shingles few sets hold meet outside the buckets' rounds, in groups below and above that limit."""
    r = random.Random(6)
    texts = []
    for k in range(2, 2 * N.RARE + 2):
        base = prose(120, 300 + k, [f"w{k}x{i}" for i in range(400)])
        texts += [edited(base, r, 1) if i else base for i in range(k)]
    out = sorted(tuple(x) for x in N.near_duplicates(docs(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert out == brute(texts)
