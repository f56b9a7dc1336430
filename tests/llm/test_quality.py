import zlib

import numpy as np
from pyspark.sql import functions as F

from colscope.llm import queries, quality
from tests.llm.common import awkward, empty


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op7_quality_classifier"](spark, sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    aside = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in aside]) > 0.95


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = docs.select("doc_id", F.when(F.length("text") > 300, 1).otherwise(0).alias("quality")).unionByName(spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int"))
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = quality.classify(docs, labels.withColumn("quality", F.lit(1))).collect()
    assert {r["predicted"] for r in one} == {1}
    assert quality.classify(empty(spark), labels).collect() == []


def test_scores_of_texts_and_features_agree(spark):
    docs = awkward(spark)
    rows = quality.features(docs, ["doc_id"]).withColumn("y", (F.get("f", 0) > 4).cast("double"))
    model = quality.fit(rows)
    a = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in quality.score_features(rows.drop("y"), model).collect())
    b = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in quality.score_texts(docs, model).collect())
    assert a == b


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0, 1, 1]), np.array([1, 1, 1, 1])).tolist() == [0.5, 0.5, 1, 1]
