"""Quality scores from a sparse ensemble of rules over statistics of the text.

A forest of shallow trees is grown on the labelled rows. Every path from a root to a node is a rule: a conjunction of
thresholds. A logistic regression with an absolute-value penalty (lasso) weighs the rules, and most weights become zero.
What is left is compiled into one Spark column, so scoring is a projection inside code generation.

Trees and weights are fitted by Spark over all labelled rows; only trees and weights reach the driver.
"""

from __future__ import annotations

import functools
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from winnow.llm.quality import repeated_words
from winnow.llm.store import saved

#: Shares are of bytes, words or lines of the text.
STATISTICS = (
    "words", "word_bytes", "longest_word", "symbols", "capitals", "digits", "stops", "marks", "commas", "bars", "wide",
    "distinct_words", "top_word", "repeated", "lines", "line_words", "same_lines", "ended_lines", "short_lines", "packed",
)
#: Bytes counted for a statistic, as a share of all word bytes.
CLASSES = {
    "symbols": b"#*$%&<>@^_~=\\{}[]", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".;:",
    "marks": b"!?", "commas": b",", "bars": b"|/", "wide": bytes(range(128, 256)),
}


@dataclass(frozen=True)
class Settings:
    trees: int = 30
    depth: int = 3
    #: Labelled rows a node of a tree must have at least.
    node_rows: int = 15
    #: Weight of the lasso penalty.
    penalty: float = 5e-4
    #: Weights below this are left out.
    least_weight: float = 1e-3
    iterations: int = 60
    seed: int = 12


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, above, threshold) that must all hold, and the weight in the log-odds."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return functools.reduce(operator.and_, [(F.col(s) > t) if above else (F.col(s) <= t) for s, above, t in self.conditions])

    def holds(self, row: dict[str, float]) -> bool:
        return all((row[s] > t) == above for s, above, t in self.conditions)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1, from the columns of STATISTICS."""
        odds = functools.reduce(operator.add, [F.when(r.column(), r.weight).otherwise(0.0) for r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-odds))


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS; all zero for a text without words."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), sum(map(len, words))
    shares = [(len(raw) - len(raw.translate(None, c))) / size for c in CLASSES.values()]
    counts = Counter(words)
    lines = [x for x in (line.split() for line in raw.split(b"\n")) if x]
    m = len(lines)
    return (
        float(n), size / n, float(max(map(len, counts))), *shares, len(counts) / n, max(counts.values()) / n, repeated_words(words) / n,
        float(m), n / m, 1 - len(set(map(tuple, lines))) / m, sum(x[-1][-1:] in b".!?:;" for x in lines) / m, sum(len(x) < 6 for x in lines) / m,
        len(zlib.compress(raw, 1)) / len(raw),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns STATISTICS of ``text``; columns of these names are replaced, all rows stay."""
    schema = StructType([StructField(s, DoubleType()) for s in STATISTICS])

    @F.pandas_udf(schema)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_statistics(t) for t in texts], columns=list(STATISTICS), dtype="float64")

    keep = [c for c in docs.columns if c not in STATISTICS]
    found = docs.withColumn("_statistics", measure.asNondeterministic()("text"))
    return found.select(*keep, *[F.col(f"_statistics.{s}").alias(s) for s in STATISTICS])


def tree_rules(described: str) -> list[Rule]:
    """All paths of the trees in a forest's description, each condition on a statistic at its tightest, without repeats."""
    rules: dict[tuple, Rule] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in described.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(found[2])], found[3] == ">", float(found[4]))))
        tight: dict[tuple[str, bool], float] = {}
        for _, (s, above, t) in path:
            tight[s, above] = t if (s, above) not in tight else (max if above else min)(tight[s, above], t)
        conditions = tuple(sorted((s, above, t) for (s, above), t in tight.items()))
        rules.setdefault(conditions, Rule(conditions))
    # The two sides of one threshold say the same; the upper one is enough.
    return [r for r in rules.values() if len(r.conditions) > 1 or r.conditions[0][1]]


def fit(labelled: DataFrame, settings: Settings = Settings()) -> RuleModel:
    """The model of rows with the columns STATISTICS and ``label`` (0 or 1).

    Rows with a null label are left out. Without rows of both labels there are no rules, and every score is the share
    of label 1 (one half without rows).
    """
    rows = saved(labelled.select(*STATISTICS, F.col("label").cast("double").alias("label")).filter("label IN (0, 1)"))
    count, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    start = RuleModel(float(_logit((ones + 0.5) / (count + 1))), ())
    if not 0 < ones < count:
        return start
    forest = RandomForestClassifier(
        numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=settings.node_rows, featureSubsetStrategy="onethird",
        subsamplingRate=0.7, seed=settings.seed,
    )
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("features", "label")
    rules = tree_rules(forest.fit(vectors).toDebugString)
    if not rules:
        return start
    held = saved(rows.select(F.array(*[r.column().cast("double") for r in rules]).alias("held"), "label"))
    lasso = LogisticRegression(regParam=settings.penalty, elasticNetParam=1.0, maxIter=settings.iterations)
    found = lasso.fit(held.select(array_to_vector("held").alias("features"), "label"))
    weighted = [Rule(r.conditions, float(w)) for r, w in zip(rules, found.coefficients) if abs(w) >= settings.least_weight]
    return RuleModel(float(found.intercept), tuple(weighted))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def train_rows(measured: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The labelled rows that may be learnt from: those whose ``crc32(doc_id)`` is no multiple of ``folds``.

    A document with several labels has the one most of them give, and 1 if they are even; null labels do not count.
    """
    one = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return measured.select("doc_id", *STATISTICS).join(one, "doc_id").filter(~held_out(folds))


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def quality_scores(measured: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``with_statistics`` with ``held_out``, ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on).

    Only statistics enter the score. A null or empty text has statistics of zero and the score these get; a row without a doc_id is scored, and
    is neither held out nor learnt from. Repeated rows stay; rows with the same statistics get the same score. An
    empty table stays empty. Columns of ``measured`` with the names of results are replaced.
    """
    model = fit(train_rows(measured, labels), settings)
    keep = [c for c in measured.columns if c not in {"held_out", "score", "predicted"}]
    scored = measured.withColumn("held_out", held_out()).withColumn("score", model.score())
    return scored.select(*keep, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
