import os
import random

import pytest
from pyspark.sql import functions as F

from colscope import session
from colscope.constants import FOREST
from colscope.operators import encode, ordering, relations
from colscope.operators.encode import string_index
from colscope.operators.relations import column_relations, folded_label


@pytest.fixture(scope="module")
def encoded(spark):
    rnd = random.Random(2)
    data = []
    for _ in range(400):
        a = rnd.choice("pqr")
        data.append((a, a if rnd.random() < 0.9 else "p", rnd.random(), ord(a) + rnd.random() / 10))
    df = spark.createDataFrame(data, "a string, b string, noise double, n double")
    return string_index(df, ["a", "b"], "_index").drop("a", "b")


def test_related_columns_rank_first(encoded):
    cols = ["a_index", "b_index", "noise", "n"]
    out = column_relations(encoded, cols, numTrees=10).collect()
    by = {}
    for r in out:
        by.setdefault(r["label"], []).append(r)
    assert set(by) == set(cols)
    for label, group in by.items():
        assert {r["feature"] for r in group} == set(cols) - {label}
        assert sum(r["importance"] for r in group) == pytest.approx(1.0)
        order = sorted(group, key=lambda r: r["rank"])
        assert [r["rank"] for r in order] == [1, 2, 3]
        assert [(-r["importance"], r["feature"]) for r in order] == sorted((-r["importance"], r["feature"]) for r in group)
    assert next(r for r in by["a_index"] if r["rank"] == 3)["feature"] == "noise"
    assert next(r for r in by["n"] if r["rank"] == 3)["feature"] == "noise"


def test_rows_without_a_label_are_left_out(encoded):
    gaps = encoded.withColumn("n", F.when(F.rand(1) < 0.3, F.lit(float("nan"))).otherwise(F.col("n")))
    out = column_relations(gaps, ["a_index", "noise", "n"], ["n"], numTrees=5).collect()
    assert sum(r["importance"] for r in out) == pytest.approx(1.0)


def test_columns_must_be_numbers(spark):
    with pytest.raises(ValueError):
        column_relations(spark.createDataFrame([("a", 1)], "s string, n int"), ["s", "n"])


def test_forest_settings():
    assert FOREST == {
        "maxBins": 30, "subsamplingRate": 0.3, "maxDepth": 5, "minInfoGain": 0.0,
        "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 10, "numTrees": 50, "seed": 27,
    }


def test_near_unique_columns_and_missing_labels(spark):
    """Every column as label: a code of its own for each row, half of the labels missing, and no label at all."""
    rows = [(f"u{i}", "ab"[i % 2] if i < 100 else None, float(i % 2), None) for i in range(200)]
    df = spark.createDataFrame(rows, "code string, side string, n double, none double")
    df = encode.index_by_join(df, ["code", "side"], "_index").drop("code", "side")
    out = column_relations(df, df.columns, numTrees=5).collect()
    by = {(r["label"], r["feature"]): r for r in out}
    assert len(by) == 12
    assert by["side_index", "n"]["rank"] == 1
    # what occurs once tells nothing
    assert by["side_index", "code_index"]["importance"] == 0.0
    assert all(by["none", c]["importance"] == 0.0 for c in df.columns if c != "none")


def test_few_rows_and_many_categories(spark):
    """Fewer labelled rows than a column has categories, itself fewer than bins."""
    rows = [(f"c{i % 20}", float(i % 3) if i < 12 else None) for i in range(60)]
    df = encode.index_by_join(spark.createDataFrame(rows, "c string, y double"), ["c"], "_index").drop("c")
    assert column_relations(df, ["c_index", "y"], ["y"], numTrees=3).count() == 1


@pytest.fixture(scope="module")
def coded(spark):
    """Categories with a number of their own, which a class and a number follow."""
    rnd = random.Random(8)
    places = [rnd.random() for _ in range(60)]
    rows = [(i, float(c), float(int(places[c] * 4)), places[c] + rnd.random() / 5) for i in range(900) for c in [min(59, int(rnd.expovariate(0.05)))]]
    return rows, spark.createDataFrame(rows, "_row long, c double, k double, y double")


def test_means_leave_the_own_fold_out(spark, coded):
    rows, df = coded
    fold = {r["_row"]: r["fold"] for r in df.select("_row", ordering._fold().alias("fold")).collect()}
    prior = sum(y for *_, y in rows) / len(rows)
    for hot in (1000, 7):
        size = ordering.HOT_CATEGORIES
        ordering.HOT_CATEGORIES = hot
        try:
            got = {r["_row"]: r["m"] for r in ordering.ordered_categories(df, ["c"], ["m"], [60], "y", None).collect()}
        finally:
            ordering.HOT_CATEGORIES = size
        for i, c, _, _ in rows:
            others = [y for j, d, _, y in rows if d == c and fold[j] != fold[i]]
            want = (sum(others) + ordering.PRIOR_ROWS * prior) / (len(others) + ordering.PRIOR_ROWS) if others else prior
            assert got[i] == pytest.approx(want)


def test_classes_lie_along_the_first_component(coded):
    import numpy as np

    rows, df = coded
    (found,) = ordering.class_places(df, ["c"], "k", 4)
    table = np.zeros((60, 4))
    for _, c, k, _ in rows:
        table[int(c), int(k)] += 1
    table = table[table.sum(axis=1) > 0]
    n = table.sum(axis=1)
    centred = table / n[:, None] - table.sum(axis=0) / n.sum()
    _, vectors = np.linalg.eigh((centred * n[:, None]).T @ centred)
    assert abs(np.dot(vectors[:, -1], found)) == pytest.approx(1.0)


def test_wide_labels_are_folded(spark):
    df = spark.createDataFrame([(f"u{i % 300}",) for i in range(900)], "code string")
    df = encode.index_by_join(df, ["code"], "_index")
    out, n = folded_label(df, "code_index", 40)
    found = {r[0] for r in out.select("code_index").distinct().collect()}
    assert n == 40 and found <= set(range(40)) and len(found) > 30
    assert out.where("code_index < 30").count() == 90


def test_equal_rows_are_counted_and_drawn_in_blocks(spark, monkeypatch):
    """Of a long table trees draw blocks of equal rows; all rows count, and what is planted leads as before."""
    rows = [(float(i % 7), float(i % 40), float(i % 7) * 2 + float(i % 3)) for i in range(4200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    held = relations.counted(df.withColumn(relations.WEIGHT, F.lit(1).cast("long")), ["a", "b", "y"])
    assert held.count() == 840
    for most, size, blocks in ((4200, 1, 4200), (1400, 3, 1680), (420, 10, 840)):
        monkeypatch.setattr(relations, "FOREST_ROWS", most)
        cut, found = relations.in_blocks(held, 4200)
        got = cut.agg(F.sum(relations.WEIGHT), F.max(relations.WEIGHT), F.count("*")).first()
        assert found == size and tuple(got) == (4200, min(size, 5), blocks)
        out = column_relations(df, df.columns, ["y"], numTrees=10).collect()
        assert min(out, key=lambda r: r["rank"])["feature"] == "a"
        assert sum(r["importance"] for r in out) == pytest.approx(1.0)


def test_a_node_holds_as_many_rows_however_they_are_drawn(spark, monkeypatch):
    """A leaf needs its ten rows, be they in one block: a class of 40 equal rows can still be told apart."""
    monkeypatch.setattr(relations, "FOREST_ROWS", 100)
    rows = [(float(i < 400), float(i % 5), 1.0 if i < 400 else 0.0) for i in range(10_000)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    out = column_relations(df, df.columns, ["y"], numTrees=10).collect()
    assert next(r for r in out if r["feature"] == "a")["importance"] > 0.9


def test_numbers_of_many_values_are_cut_into_even_bins(spark):
    df = spark.createDataFrame([(float(i), float(i % 30)) for i in range(3000)], "many double, few double")
    _, _, cuts = relations.filled_numbers(df, df.columns, 30)
    assert list(cuts) == ["many"] and len(cuts["many"]) == 29
    sizes = [r["count"] for r in relations.in_bins(df, cuts).groupBy("many").count().collect()]
    assert len(sizes) == 30 and max(sizes) - min(sizes) <= 12


def test_what_occurs_in_one_fold_takes_the_mean_of_all(spark):
    """A column without repeats has nothing to look up."""
    df = spark.createDataFrame([(i, float(i), float(i % 4), float(i % 2)) for i in range(200)], "_row long, u double, c double, y double")
    means, overall = ordering.category_means(df, ["u", "c"], [F.col("y")] * 2)
    assert overall == [0.5, 0.5] and {r["f"] for r in means.select("f").distinct().collect()} == {1}
    out = ordering.with_means(df, ["u", "c"], ["mu", "mc"], means, overall, [200, 4])
    assert {r["mu"] for r in out.collect()} == {0.5}


def test_only_what_is_looked_up_is_kept_on_disk(spark, monkeypatch):
    """Numbered rows are written in Parquet and deleted; of the categories' sums only those of several folds are written."""
    kept, numbered = {}, []

    def written(df, label):
        out = session.written(df, label)
        kept.setdefault(label, []).append(out.count())
        numbered.extend(out.inputFiles() if label == "rows" else [])
        return out

    monkeypatch.setattr(ordering, "written", written)
    rows = [(f"u{i}", f"c{i % 50}", float(i % 50 % 7)) for i in range(600)]
    df = encode.index_by_join(spark.createDataFrame(rows, "u string, c string, y double"), ["u", "c"], "_index").drop("u", "c")
    out = column_relations(df, df.columns, ["y"], numTrees=3).collect()
    assert next(r for r in out if r["rank"] == 1)["feature"] == "c_index"
    assert kept["rows"] == [600] and kept["category-sums"] == [50]
    assert numbered and not any(os.path.exists(f.removeprefix("file:")) for f in numbered)
