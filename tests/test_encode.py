from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colscope.operators import encode


@pytest.fixture(scope="module")
def words(spark):
    data = [(i, f"w{i * i % 23}" if i % 9 else None, f"v{i % 3}") for i in range(300)]
    return spark.createDataFrame(data, "id int, a string, b string")


def expected_index(df, c):
    counts = Counter(r[c] for r in df.collect() if r[c] is not None)
    order = sorted(counts, key=lambda t: (-counts[t], t))
    return {t: float(i) for i, t in enumerate(order)}


def test_index_follows_frequency_then_label(words):
    ix = expected_index(words, "a")
    out = encode.string_index(words, ["a", "b"]).collect()
    assert len(out) == words.where("a is not null").count()
    assert all(r["a-index"] == ix[r["a"]] for r in out)
    kept = encode.string_index(words, ["a"], handle_invalid="keep")
    assert kept.where("a is null").select("a-index").distinct().collect()[0][0] == float(len(ix))


def test_too_many_labels(words):
    with pytest.raises(ValueError):
        encode.fit_string_index(words, ["a"], max_labels=5)


def test_labels_from_metadata(words):
    out = encode.index_labels(encode.string_index(words, ["a", "b"]))
    found = {(r["column"], r["label"]): r["index"] for r in out.collect()}
    expected = {("a-index", t): i for t, i in expected_index(words, "a").items()}
    expected |= {("b-index", t): i for t, i in expected_index(words, "b").items()}
    assert found == expected
    with pytest.raises(ValueError):
        encode.index_labels(words, ["a"])


@pytest.mark.parametrize("hot", [0, 4, 1000])
def test_index_by_join_agrees(words, monkeypatch, hot):
    monkeypatch.setattr(encode, "HOT_LABELS", hot)
    a, b = expected_index(words, "a"), expected_index(words, "b")
    out = encode.index_by_join(words, ["a", "b"]).collect()
    assert sorted(r["id"] for r in out) == list(range(300))
    assert all(r["a-index"] == (a[r["a"]] if r["a"] else None) and r["b-index"] == b[r["b"]] for r in out)


def test_rank_labels_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select(F.concat(F.lit("k"), F.expr("id % 700")).alias("x"))
        found = {r["label"]: r["index"] for r in encode.rank_labels(df, ["x"]).collect()}
        assert found == expected_index(df, "x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_splits():
    s = encode.equal_splits(0, 10)
    assert s[0] == float("-inf") and s[-1] == float("inf") and s[1:-1] == [float(i) for i in range(1, 10)]
    assert encode.equal_splits(3, 3) == [float("-inf"), float("inf")]
    with pytest.raises(ValueError):
        encode.equal_splits(None, 3)
    with pytest.raises(ValueError):
        encode.equal_splits(4, 3)


def test_bucketize(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.999, 5.0), (1.0, 5.0), (10.0, 5.0), (99.0, 5.0)], "x double, k double")
    out = encode.bucketize(df, ["x", "k"], {"x": (0, 10), "k": (5, 5)})
    assert [r["x-bucketized"] for r in out.collect()] == [0.0, 0.0, 1.0, 9.0, 9.0]
    assert {r["k-bucketized"] for r in out.collect()} == {0.0}
    with pytest.raises(ValueError):
        encode.bucketize(df, ["x"], {"k": (1, 2)})


def test_missing_numbers_have_no_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (float("nan"),)], "x double")
    assert [r["x-bucketized"] for r in encode.bucketize(df, ["x"]).collect()] == [0.0, 9.0, None]


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 7.0), (5.0, 7.0), (10.0, 7.0)], "x double, k double")
    out = encode.minmax_scale(encode.assemble(df, ["x", "k"], "v"), "v", "s").orderBy("x")
    assert [r["a"] for r in out.select(vector_to_array("s").alias("a")).collect()] == [[0.0, 0.5], [0.5, 0.5], [1.0, 0.5]]


def test_feature_vector_layout(spark):
    df = spark.createDataFrame(
        [("a", 0.0, True), ("a", 5.0, False), ("b", 10.0, True)], "s string, n double, `t-x` boolean"
    )
    frame, model = encode.prepare_features(df, ["s"], ["n"], ["t-x"])
    assert frame.columns == ["features", "s-index", "n-bucketized"]
    got = sorted(r["v"] for r in frame.select(vector_to_array("features").alias("v")).collect())
    assert got == [[0.0, 1.0, 1.0, 1.0], [1.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.5, 0.0]]
    # a label not seen before is skipped
    new = spark.createDataFrame([("zz", 1.0, True), ("b", 1.0, True)], df.schema)
    assert model.transform(new).count() == 1


def test_cap_terms(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "p string, q string")
    assert encode.cap_terms(df, ["p", "q"], 2) == {"p": ["a", "b"]}


def test_labels_are_the_same_however_they_are_kept(spark):
    df = spark.createDataFrame([(f"v{i % 7}" if i % 3 else None, f"w{i % 3}") for i in range(60)], "a string, b string")
    kept = [{tuple(r) for r in encode.index_labels(encode.string_index(df, ["a", "b"], max_labels=most)).collect()} for most in (100, 5, 1)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 10
    with pytest.raises(ValueError):
        encode.index_labels(df, ["a"])
