"""Rules of trees, their compiled column, and accuracy on rows that were held out."""

import math
import zlib

from helpers import docs, prose
from winnow.llm import rule_ensemble as R

SF = "/root/testdata/sf0.01"


def test_paths_of_a_tree():
    described = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 4.0)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      If (feature 0 <= 2.0)
       Predict: 1.0
      Else (feature 0 > 2.0)
       Predict: 0.0
    Else (feature 0 > 4.0)
     Predict: 1.0
"""
    got = {r.conditions for r in R.tree_rules(described)}
    assert got == {
        (("symbols", False, 0.25), ("words", False, 4.0)), (("symbols", True, 0.25), ("words", False, 4.0)), (("words", True, 4.0),),
        (("symbols", True, 0.25), ("words", False, 2.0)), (("symbols", True, 0.25), ("words", False, 4.0), ("words", True, 2.0)),
    }


def test_compiled_column_is_the_sum_of_the_rules(spark):
    model = R.RuleModel(0.4, (R.Rule((("words", True, 3.0),), -1.5), R.Rule((("symbols", False, 0.1), ("words", False, 9.0)), 0.75)))
    texts = [None, "", "a b c d", "a # # b", "one two three four five six seven eight nine ten", " \n\t"]
    rows = R.with_statistics(docs(spark, texts)).withColumn("score", model.score()).collect()
    for r in rows:
        odds = 0.4 + sum(rule.weight for rule in model.rules if rule.holds(r.asDict()))
        assert abs(r.score - 1 / (1 + math.exp(-odds))) < 1e-12


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = R.saved(R.with_statistics(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).drop("text"))
    out = R.quality_scores(table, labels)
    assert out.count() == table.count()
    rows = out.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in rows if r.held_out]
    zeros, ones = [[r.score for r in test if r.quality == q] for q in (0, 1)]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert len(zeros) >= 3 and area >= 0.9, area


def test_labels_of_held_out_rows_are_not_read(spark):
    texts = [prose(60, k) if k % 2 else "##*** " * 40 for k in range(120)]
    table = R.saved(R.with_statistics(docs(spark, texts)))
    true = spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    wrong = spark.createDataFrame([(k, 1 - k % 2 if zlib.crc32(str(k).encode()) % 5 == 0 else k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in R.quality_scores(table, t).collect()} for t in (true, wrong))
    assert a == b and all((a[k] > 0.5) == bool(k % 2) for k in a)


def test_odd_tables(spark):
    d = docs(spark, [prose(30, 1), None, "", prose(30, 1)]).selectExpr("IF(doc_id = 1, NULL, doc_id) AS doc_id", "text", "1 AS words", "'x' AS score", "2 AS label", "3 AS quality")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = R.quality_scores(R.with_statistics(d), none)
    assert out.count() == 4 and len(set(out.columns)) == len(out.columns) and {r.score for r in out.collect()} == {0.5}
    mixed = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (2, None, 0), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert R.quality_scores(R.with_statistics(d), mixed).filter("score > 0.5").count() == 4
    assert R.quality_scores(R.with_statistics(docs(spark, [])), mixed).count() == 0
    assert R.text_statistics("wort " * 200000)[0] == 200000
