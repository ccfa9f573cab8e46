"""Small tables for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, schema=SCHEMA):
    rows = [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def prose(n, seed, words=None):
    """``n`` words in sentences and lines."""
    r = random.Random(seed)
    words = words or [f"{a}{b}{c}" for a in ("ba", "do", "ri", "ken", "sta") for b in ("lo", "mi", "ter", "na") for c in ("n", "s", "ve", "ly", "d")]
    out = []
    for i in range(n):
        w = r.choice(words)
        if i % 9 == 8 or i == n - 1:
            w += ".\n" if i % 27 == 26 else "."
        out.append(w)
    return " ".join(out).replace("\n ", "\n")
