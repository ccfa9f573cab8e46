"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``SIDE`` half-keys, each of ``ROWS`` minima, are computed per document. A table key
joins one half-key of either collection, so ``SIDE * SIDE`` tables cost ``2 * SIDE * ROWS`` minima
instead of ``2 * ROWS * SIDE * SIDE``. At a similarity of 0.85 a pair shares a bucket with a probability of 0.999.

Equal sets are one node. Buckets are not expanded into all pairs (see ``buckets``), and all links are confirmed on full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from winnow.functions.components import connected_components
from winnow.llm.buckets import Compare, bucket_links
from winnow.llm.store import saved
from winnow.llm.words import WordHashes, gram_hashes, lower_words, mix, word_hashes

SIDE, ROWS = 8, 3
SHINGLE = 5
#: Linked from this percentage of the union on.
PERCENT = 85
#: Sets that share a shingle are compared apart from the buckets if they are so few.
RARE = 8

#: Half-keys of either collection for a similarity of 0.80: a pair there shares a bucket with a probability of 0.998.
SIDE_80 = 10

_FACTORS = mix(np.arange(1, 2 * SIDE_80 * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, 2 * SIDE_80 * ROWS + 1001, dtype=np.uint64))
_BLOCK = 4096


def shingle_set(text: str | None, memo: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one without words none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words, memo), min(SHINGLE, len(words))))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def half_keys(shingles: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The ``2 * side`` half-keys of a set."""
    factors, shifts = _FACTORS[: 2 * side * ROWS], _SHIFTS[: 2 * side * ROWS]
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), _BLOCK):
        np.minimum(low, (shingles[None, a : a + _BLOCK] * factors[:, None] + shifts[:, None]).min(axis=1), out=low)
    return gram_hashes(low, ROWS)[::ROWS].view(np.int64)


def signatures(text: Column | str, side: int = SIDE) -> Column:
    """Struct of ``n_shingles``, ``node`` and ``halves`` of a text; the last two are null for a text without words."""

    @F.pandas_udf(StructType([StructField("n_shingles", LongType()), StructField("node", LongType()), StructField("halves", ArrayType(LongType()))]))
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for texts in batches:
            rows = []
            for t in texts:
                s = shingle_set(t, memo)
                rows.append((len(s), node_of(s), half_keys(s, side)) if len(s) else (0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "halves"])
            out["node"] = pd.array([r[1] for r in rows], dtype="Int64")  # not by way of floats
            yield out

    return sign.asNondeterministic()(text)


def shingle_sets(text: Column | str) -> Column:
    """Struct of ``node`` and the sorted ``shingles`` of a text with words."""

    @F.pandas_udf(StructType([StructField("node", LongType()), StructField("shingles", ArrayType(LongType()))]))
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for texts in batches:
            found = [shingle_set(t, memo) for t in texts]
            yield pd.DataFrame({"node": np.array([node_of(s) for s in found], np.int64), "shingles": [s.view(np.int64) for s in found]})

    return sets.asNondeterministic()(text)


def _bands(nodes: DataFrame, side: int) -> DataFrame:
    h = F.col("halves")
    keys = [F.xxhash64(F.lit(i * side + j), h[i], h[side + j]) for i in range(side) for j in range(side)]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (``rep``, ``node``) pairs with their Jaccard distance ``far`` and whether they are ``linked``, on full sets."""
    a = sets.select(F.col("node").alias("rep"), F.col("shingles").alias("_a"))
    b = sets.select("node", F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    sizes = pairs.join(b.hint("merge"), "node").join(a.hint("merge"), "rep").select("rep", "node", both.alias("both"), (F.size("_a") + F.size("_b")).alias("sum"))
    union = F.col("sum") - F.col("both")
    return sizes.select("rep", "node", (1 - F.col("both") / union).alias("far"), (100 * F.col("both") >= percent * union).alias("linked"))


def rare_links(sets: DataFrame, compare_all: Compare, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, size, own) of ``sets``, where ``own`` counts the shingles that at most ``RARE`` sets hold, and the links (src, dst) of sets that share such a one.

    Sets that share none have at most those shingles in common that are not ``own``. Of sets that share some, only those meet that share enough.
    """
    shingles = sets.select("node", F.explode("shingles").alias("shingle")).withColumn("n", F.count("*").over(Window.partitionBy("shingle")))
    rare = shingles.filter(F.col("n") <= RARE).groupBy("shingle").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # RARE nodes at most
    own = rare.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("own"))
    sizes = sets.select("node", F.size("shingles").cast("long").alias("size")).join(own, "node", "left")
    sizes = saved(sizes.select("node", "size", F.coalesce("own", F.lit(0)).cast("long").alias("own")))
    two = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, RARE), lambda b: F.struct(a.alias("rep"), b.alias("node")))))
    shared = rare.filter(F.size("nodes") > 1).select(F.inline(two)).groupBy("rep", "node").agg(F.count("*").alias("shared"))
    of = lambda side, s: sizes.select(F.col("node").alias(side), F.col("size").alias(f"size{s}"), (F.col("size") - F.col("own")).alias(f"rest{s}"))
    both = F.least("rest_a", "rest_b") + F.col("shared")
    near = shared.join(of("rep", "_a"), "rep").join(of("node", "_b"), "node").filter(100 * both >= percent * (F.col("size_a") + F.col("size_b") - both))
    linked = compare_all(saved(near.select("rep", "node"))).filter("linked")
    return sizes, saved(linked.select(F.col("rep").alias("src"), F.col("node").alias("dst")))


def links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT, side: int = SIDE) -> DataFrame:
    """Edges (``src``, ``dst``) between nodes, with the components of all linked pairs that share a bucket.

    ``nodes`` has (node, halves, doc_id): one document for each distinct set. ``docs`` gives the
    texts, which are read again for the members of buckets only.
    """

    def prepare(members: DataFrame):
        wanted = members.join(nodes.select("node", "doc_id"), "node").select("doc_id", F.col("node").alias("_node"))
        texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select("_node", shingle_sets("text").alias("s"))
        sets = saved(texts.filter("s.node = _node").select("s.node", "s.shingles").dropDuplicates(["node"]))
        several = lambda pairs, late=False: compare(pairs, sets, percent)
        return several, *rare_links(sets, several, percent)

    return bucket_links(_bands(nodes, side), prepare, 1 - percent / 100)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, side: int = SIDE) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``) for each row of ``docs``.

    A null or empty text has no shingles and is linked with nothing; a row without a doc_id has no
    component and is kept. Rows that repeat a doc_id each get the component of their own text. Only ``doc_id`` and ``text`` are
    read, so other columns may have any name.
    """
    base = saved(docs.select("doc_id", signatures("text", side).alias("s")).select("doc_id", "s.n_shingles", "s.node", "s.halves"))
    named = base.filter("doc_id is not null and node is not null")
    nodes = saved(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("halves").alias("halves")))
    groups = connected_components(links(nodes, docs, percent, side)).withColumnRenamed("node", "_node")
    least = nodes.select("node", "doc_id").join(groups, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    least = saved(least.select("node", "doc_id", "component"))
    first = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = least.join(first, "component").select("node", "component_id")
    alone = base.filter("doc_id is null or node is null").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return named.join(found, "node").select(*columns).unionByName(alone.select(*columns))


def unique_documents(docs: DataFrame, percent: int = PERCENT, side: int = SIDE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest doc_id.

    Rows that repeat the same doc_id count as one document. Rows without a doc_id stay.
    """
    kept = near_duplicates(docs, percent, side).filter("kept and doc_id is not null").select("doc_id").distinct()
    rest = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


SQL_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
