import json

import pytest
from pyspark.sql import functions as F

from colscope.sources import catalog as cat
from colscope.sources.tables import read_csv, read_table, wrap_arrays

DOC = {
    "data-date": {"type": "date", "format": "dd-MM-yyyy", "metrics": {"minValue": 1000, "maxValue": 2000}},
    "data-shop": {
        "type": "terms", "typeSettings": {"separator": ";"}, "values": [{"north": 3}, {"south": 1}],
        "metrics": {"emptyLines": 2, "valuesCount": 2, "avgValuesCount": 1.5},
    },
    "data-card": {"type": "terms", "values": ["yes", "no"]},
    "data-age": {"type": "number", "metrics": {"minValue": 18, "maxValue": 75.5, "avg": 40.25}},
    "data-note": {"type": "other"},
    "data-what": {"label": "unknown type"},
    "city": {"type": "string", "array": ["A", "B"]},
    "accent é ?": {"type": "terms"},
}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("doc") / "catalog.json"
    path.write_text(json.dumps(DOC, ensure_ascii=False), encoding="utf-8")
    return cat.read_catalog(spark, str(path)).cache()


def test_read(catalog):
    rows = {r["column"]: r for r in catalog.collect()}
    assert set(rows) == set(DOC)
    age, shop = rows["data-age"], rows["data-shop"]
    assert (age["min_value"], age["max_value"], age["avg"]) == (18.0, 75.5, 40.25)
    assert (shop["empty_lines"], shop["values_count"], shop["avg_values_count"]) == (2, 2, 1.5)
    assert rows["data-date"]["format"] == "dd-MM-yyyy"


def test_values_in_all_three_shapes(catalog):
    def values(c):
        return {r["term"]: r["count"] for r in cat.col_values(catalog, c).collect()}

    assert values("data-shop") == {"north": 3, "south": 1}
    assert values("data-card") == {"yes": None, "no": None}
    assert values("city") == {"A": None, "B": None}
    assert values("data-age") == {}


def test_multi(catalog):
    found = {r["column"]: r["is_multi"] for r in catalog.collect()}
    assert found["data-shop"] is True and found["data-card"] is False
    assert found["data-age"] is None and found["city"] is None
    assert cat.is_multi(catalog, "data-shop").first()["is_multi"] is True


def test_lookup_never_fails(catalog):
    def value(c, p):
        r = cat.col_info(catalog, c, p).first()
        return r and r["value"]

    assert value("data-age", "metrics.maxValue") == "75.5"
    assert value("data-age", "metrics.none.deeper") is None
    assert value("data-shop", "typeSettings.separator") == ";"
    assert value("absent", "type") is None
    assert cat.col_type(catalog, "data-what").first()["type"] is None
    assert tuple(cat.col_bounds(catalog, "data-date").first())[1:] == (1000.0, 2000.0)


def test_column_choice(spark, catalog):
    names = {r["column"] for r in cat.select_columns(catalog).collect()}
    assert names == {"data-date", "data-shop", "data-card", "data-age", "data-what"}
    assert {r["column"] for r in cat.quali_columns(catalog).collect()} == {"data-shop", "data-card", "accent é ?"}
    df = spark.createDataFrame([(1, 2, 3, 4)], ["city", "data-age", "data-note", "data-card"])
    assert cat.clean_columns(df, catalog).columns == ["data-age", "data-card"]


def test_entries(catalog):
    e = cat.entries(catalog)
    assert e["city"]["values"] == ["A", "B"] and e["data-age"]["max"] == 75.5
    assert e["data-date"]["format"] == "dd-MM-yyyy" and e["data-age"]["values"] is None


def test_build(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', 1.0D, timestamp_ntz'1970-01-01 00:00:01', array('p', 'q'), named_struct('lat', 1.0D, 'lon', 5.0D)),"
        " ('a', 3.0D, null, array('p'), named_struct('lat', 2.0D, 'lon', 4.0D)), (null, double('NaN'), null, null, null)"
        " AS t(s, n, d, l, g)"
    ).withColumn("x", F.create_map(F.lit("k"), F.lit(1))).withColumn("empty", F.lit(None).cast("int"))
    rows = {r["column"]: r for r in cat.build_catalog(df).collect()}
    assert {c: r["type"] for c, r in rows.items()} == {
        "s": "terms", "n": "number", "d": "date", "l": "terms", "g": "coordinates", "x": "other", "empty": "number",
    }
    assert (rows["s"]["empty_lines"], rows["s"]["values_count"]) == (1, 1)
    assert (rows["n"]["min_value"], rows["n"]["max_value"], rows["n"]["avg"]) == (1.0, 3.0, 2.0)
    assert (rows["n"]["empty_lines"], rows["n"]["values_count"]) == (1, 2)
    assert rows["d"]["min_value"] == 1000.0
    assert (rows["l"]["values_count"], rows["l"]["avg_values_count"]) == (2, 1.5)
    assert tuple(rows["g"]["bounding_box"]) == (2.0, 4.0, 1.0, 5.0)
    assert rows["x"]["values_count"] is None
    assert (rows["empty"]["empty_lines"], rows["empty"]["values_count"]) == (3, 0)
    sketch = {r["column"]: r["values_count"] for r in cat.build_catalog(df, approximate=True).collect()}
    assert (sketch["s"], sketch["n"], sketch["l"]) == (1, 2, 2)


def test_values_of_all_types_are_counted_in_one_scan(spark):
    df = spark.sql(
        "SELECT id % 7 AS l, cast(id % 5 AS int) AS i, cast(id % 4 AS double) / 3 AS d, cast(id % 3 AS float) AS f,"
        " cast(id % 6 AS decimal(9, 2)) AS n, id % 2 = 0 AS b, if(id % 9 = 0, null, repeat(cast(id % 8 AS string), 70)) AS s,"
        " date_add(date '2020-01-01', cast(id % 10 AS int)) AS t, timestamp_micros(id % 11) AS u,"
        " cast(timestamp_micros(id % 12 * 1000001) AS timestamp_ntz) AS z FROM range(500)"
    )
    df = df.withColumn("d", F.when(F.col("l") == 3, F.lit(float("nan"))).when(F.col("l") == 4, F.lit(-0.0)).otherwise(F.col("d")))
    built = cat.build_catalog(df)
    rows = {r["column"]: r["values_count"] for r in built.collect()}
    assert rows == {"l": 7, "i": 5, "d": 4, "f": 3, "n": 6, "b": 2, "s": 8, "t": 10, "u": 11, "z": 12}
    # the aggregate's scan, and one for the counts of all ten columns
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 500") == 2


def test_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", 5, ["x", "y"])], "s string, n int, l array<string>")
    cat.catalog_document(df).write.text(str(tmp_path / "doc"))
    back = {r["column"]: r for r in cat.read_catalog(spark, str(tmp_path / "doc")).collect()}
    assert (back["n"]["min_value"], back["n"]["max_value"]) == (1.0, 5.0)
    assert back["l"]["values"] == {"x": 2, "y": 1}


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "string"), ("b", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "x"), (None, "y")]


def test_declared_arrays(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"]), (None, 2, None)], "s string, n int, l array<string>")
    df.write.json(str(tmp_path / "t"))
    out = read_table(spark, "json", str(tmp_path / "t"), array_cols=["s", "n", "l"]).orderBy("n")
    assert [(r["s"], r["n"], r["l"]) for r in out.collect()] == [(["a"], ["1"], ["x"]), (None, ["2"], None)]
    with pytest.raises(ValueError):
        wrap_arrays(df, ["absent"])
