from datetime import datetime, timedelta

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colscope.plans.flows import analyse_relations, index_for_relations, prepare_mixed


def test_relations_from_text(spark):
    data = [
        (f"c{i % 40}", "rich" if i % 2 else "poor", str(i % 2 * 100 + i % 7), f"{i % 28 + 1:02d}-{i % 12 + 1:02d}-{2000 + i % 2}")
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "city string, kind string, amount string, funded string")
    entries = {
        "city": {"type": "string"}, "kind": {"type": "string"}, "amount": {"type": "int"},
        "funded": {"type": "date", "format": "dd-MM-yyyy"},
    }
    indexed, names = index_for_relations(df, entries)
    # the month bucket takes part, and all 40 cities are kept
    assert names == ["amount_quanti", "city_quali_index", "kind_quali_index", "funded_date_month_quali_index"]
    assert indexed.select("city_quali").distinct().count() == 40
    fewer, _ = index_for_relations(df, entries, max_categories=10)
    assert fewer.select("city_quali").distinct().count() == 10
    assert fewer.where("city_quali = 'null'").count() == 0
    out = analyse_relations(df, entries, labels=["kind_quali_index"], numTrees=10).collect()
    assert min(out, key=lambda r: r["rank"])["feature"] in ("amount_quanti", "funded_date_month_quali_index")


@pytest.fixture(scope="module")
def typed(spark):
    start = datetime(2024, 1, 1)
    data = [
        (i, ["a", "b"] if i % 2 else ["b"], ["p"] if i % 3 else ["q", "p"], i % 2 == 0 and "m" or "f",
         float(i), start + timedelta(days=i), None if i % 3 else "x")
        for i in range(60)
    ]
    return spark.createDataFrame(
        data, "id int, tags array<string>, multi array<string>, sex string, age double, at timestamp_ntz, gone string"
    )


def test_prepare_mixed(typed):
    out = prepare_mixed(typed, {"multi": {"is_multi": True}, "age": {"min": 0.0, "max": 100.0}}, keep=["id"])
    assert out.nulls.dropped == ["gone"]
    assert out.quali == ["sex", "tags-str"]
    assert out.quanti == ["age", "at_int_index"]
    assert out.multi == ["multi-p", "multi-q"]
    assert out.frame.columns == ["id", "features", "sex-index", "tags-str-index", "age-bucketized", "at_int_index-bucketized"]
    # 2 sexes, 2 tags, 2 scaled numbers, 2 indicators
    assert out.frame.select(F.size(vector_to_array("features")).alias("n")).distinct().collect() == [(8,)]
    # bins follow the catalog's bounds, not the table's
    assert out.frame.agg(F.max("age-bucketized")).first()[0] == 5.0
    d = out.distances()
    assert {r["column"] for r in d.cooccurrences.collect()} == {"sex-index", "tags-str-index"}
    assert {r["column"] for r in d.significances.collect()} == {"age-bucketized", "at_int_index-bucketized"}
    d.release()


def test_terms_beyond_the_list_are_reported(typed):
    out = prepare_mixed(typed, {"multi": {"is_multi": True}}, terms=1)
    assert {tuple(r) for r in out.lost_terms.collect()} == {("tags", 1, 30), ("multi", 1, 20)}
    assert {tuple(r) for r in prepare_mixed(typed).lost_terms.collect()} == {("tags", 0, 0), ("multi", 0, 0)}


def test_multi_valued_columns_take_part_in_distances(typed):
    out = prepare_mixed(typed, {"multi": {"is_multi": True}}, keep=["id"])
    d = out.distances(multi=True)
    found = {(r["column"], r["vx"], r["vy"]) for r in d.cooccurrences.collect()}
    assert ("multi-terms", "p", "q") in found and {c for c, _, _ in found} == {"sex-index", "tags-str-index", "multi-terms"}
    d.release()


def test_row_functions_accept_a_stream(spark, tmp_path):
    from colscope import streaming

    src = spark.createDataFrame([("x", "01-02-2020", ["a"])], "s string, d string, t array<string>")
    src.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).json(str(tmp_path / "in"))
    out = streaming.cast_by_role(
        stream, {"s": {"type": "string", "values": ["x"]}, "d": {"type": "date", "format": "dd-MM-yyyy"}}, ["s", "d"]
    )
    out = streaming.array_first_term(streaming.array_indicators(out, "t", ["a"]), "t", ["a"])
    q = (
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination(60)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["s_quali"], str(r["d_date"]), r["t-a"], r["t-str"]) == ("x", "2020-02-01", True, "a")


def test_relations_with_missing_values(spark):
    data = [
        (None if i % 7 == 0 else f"c{i % 3}", None if i % 5 == 0 else str(i % 2 * 100.0), ["bad", None, f"{i % 28 + 1:02d}/01/2001"][i % 3], i % 2 and "rich" or "poor", "x")
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "city string, amount string, paid string, kind string, place string")
    entries = {
        "city": {"type": "terms"}, "amount": {"type": "number"}, "kind": {"type": "terms"},
        "paid": {"type": "date", "format": "dd/MM/yyyy"}, "place": {"type": "coordinates"},
    }
    out = analyse_relations(df, entries, labels=["kind_quali_index", "amount_quanti"], numTrees=10).collect()
    top = {r["label"]: r["feature"] for r in out if r["rank"] == 1}
    assert top == {"kind_quali_index": "amount_quanti", "amount_quanti": "kind_quali_index"}
    for label in top:
        assert sum(r["importance"] for r in out if r["label"] == label) == pytest.approx(1)


def test_dates_booleans_and_roles_in_mixed(spark):
    data = [(i % 2 == 0, f"2024-01-{i % 28 + 1:02d}", "p", float("nan") if i % 20 == 0 else float(i), (i,)) for i in range(60)]
    df = spark.createDataFrame(data, "yes boolean, day string, skip string, v double, s struct<a:int>")
    df = df.withColumn("day", F.to_date("day"))
    out = prepare_mixed(df, {"skip": {"type": "other"}})
    assert out.quali == ["yes"] and out.quanti == ["v", "day_int_index"] and sorted(out.left_out) == ["s", "skip"]
    assert out.frame.agg(F.max("v-bucketized")).first()[0] <= 9


def test_more_labels_than_a_model_holds(spark):
    from colscope.operators import encode

    df = spark.range(3000).selectExpr("CAST(id % 1500 AS STRING) AS a", "CAST(id % 3 AS STRING) AS b", "IF(id % 50 = 0, NULL, CAST(id % 700 AS STRING)) AS c")
    for how in ("skip", "keep"):
        narrow = encode.string_index(df, ["a", "b", "c"], handle_invalid=how)
        wide = encode.string_index(df, ["a", "b", "c"], handle_invalid=how, max_labels=500)
        assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.collect()))
