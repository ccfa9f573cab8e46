"""Benchmark overlaps with and without substitutions."""

import random

import numpy as np
from helpers import docs, prose
from winnow.llm import decontaminate as D

SCHEMA = "item_id long, text string"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def test_planted_passages(spark):
    items = [words(i, n) for i, n in enumerate([40, 25, 16, 8, 60, 4])]
    swap = lambda w, every: [f"x{i}" if i % every == every - 1 else v for i, v in enumerate(w)]
    inside = lambda w, k: prose(150, k) + " " + " ".join(w) + " " + prose(150, k + 50)
    texts = {
        0: inside(items[0], 1), 1: inside(swap(items[0], 7), 2), 2: inside(items[1][5:20], 3), 3: inside([w.upper() + "," for w in items[2]], 4),
        4: inside(items[3], 5), 5: " ".join(items[4]), 6: "\n".join(swap(items[4], 9)) + " end", 7: inside(items[0] + items[1], 6),
        20: prose(500, 7), 21: None, 22: "", 23: inside(items[0][:6], 8), 24: inside(items[5], 9), 25: inside(swap(items[0], 2), 10),
    }
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], SCHEMA)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_match for r in D.contaminated(d, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 0), (7, 1)}
    assert got[0, 0] == 40 and got[2, 1] == 15 and got[4, 3] == 8
    assert {r.doc_id for r in D.clean_documents(d, bench).collect()} == {k for k in texts if k >= 20}


def test_full_filter_changes_nothing(spark):
    items = [words(i, 30) for i in range(5)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], SCHEMA)
    d = docs(spark, [prose(80, i) + " " + " ".join(w[3:28]) for i, w in enumerate(items)] + [prose(300, 99)])
    a, b = (sorted(map(tuple, D.contaminated(d, bench, D.Seeds(filter_bits=n)).collect())) for n in (6, 20))
    assert a == b and len(a) == 5


def test_masks_tolerate_substitutions():
    """Whatever single token of a 17-token window differs, some mask at some place ignores it."""
    for at in range(17):
        assert any(all(not (m[i - p] == "1") for i in [at] if p <= i < p + len(m)) for m in D.DEFAULT_SEEDS.masks for p in range(17 - len(m) + 1))


def test_best_run():
    doc, item = np.arange(100), np.arange(40, 60).copy()
    item[5] = 999
    assert D.best_run(doc, item, 40, 2) == (19, 20, 40, 0)
    assert D.best_run(doc[:45], item, 40, 2) == (5, 5, 40, 0)


def test_odd_tables(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, " ".join(words(1, 20)))], SCHEMA)
    d = docs(spark, [" ".join(words(1, 20))] * 2).selectExpr("0L AS doc_id", "text", "1 AS item_id", "2 AS toks")
    assert [tuple(r)[:3] for r in D.contaminated(d, bench).collect()] == [(0, 1, 20)]
    assert D.contaminated(d, none).count() == 0 and D.contaminated(docs(spark, []), bench).count() == 0
    assert D.clean_documents(d, none).count() == 2 and D.clean_documents(d, none).columns == d.columns


def test_substitutions_that_cost_more_than_an_end(spark):
    """Enough tokens match, but the run with the best score is a part of them; and short items with one changed token."""
    doc, item = np.arange(100), np.arange(40, 55).copy()
    item[[1, 4, 13]] = 999
    assert D.best_run(doc, item, 40, 2) == (12, 15, 40, 0)
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(10, 17)
        subs = r.sample(range(n), n - D.DEFAULT_SEEDS.needed(n))
        item = np.arange(30, 30 + n)
        item[subs] = -1
        assert D.best_run(doc, item, 30, 2)[0] >= D.DEFAULT_SEEDS.needed(n)
    items = [words(50 + n, n) for n in range(5, 10)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], SCHEMA)
    texts = [prose(30, 1) + " " + " ".join([*w[:k], "other", *w[k + 1 :]]) + " " + prose(30, 2) for w in items for k in range(len(w))] + [" ".join(w[1:]) for w in items]
    got = {(x.doc_id, x.item_id) for x in D.contaminated(docs(spark, texts), bench).collect()}
    assert got == set(enumerate([i for i, w in enumerate(items) for _ in w] + list(range(5))))
