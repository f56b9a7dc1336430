from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from colscope.columns import split_by_role
from colscope.functions.arrays import array_first_term, array_indicators
from colscope.functions.dates import date_bucketize, date_span, fit_date_buckets
from colscope.functions.typing import cast_by_role, date_to_long, whitelist_by_join


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def arrays(spark):
    data = [(1, ["a", "b"]), (2, ["z"]), (3, []), (4, None), (5, ["b", "a", "b"]), (6, [None, "a"])]
    return spark.createDataFrame(data, "id int, t array<string>")


def test_first_term(arrays):
    out = array_first_term(arrays, "t", ["a", "b"])
    assert [r["t-str"] for r in out.orderBy("id").collect()] == ["a", "others", "others", "others", "b", "others"]
    assert out.schema["t-str"].metadata == {"origin": "t"}


def test_indicators(arrays):
    out = array_indicators(arrays, "t", ["a", "z"])
    assert [tuple(r)[2:] for r in out.orderBy("id").collect()] == [
        (True, False), (False, True), (False, False), (False, False), (True, False), (True, False),
    ]


def test_array_errors(spark, arrays):
    with pytest.raises(ValueError):
        array_first_term(arrays, "id", ["a"])
    with pytest.raises(ValueError):
        array_first_term(arrays.withColumn("t-str", F.lit(1)), "t", ["a"])
    # the clash is judged by the final name, not by the bare term
    assert "t-id" in array_indicators(arrays, "t", ["id"]).columns
    with pytest.raises(ValueError):
        array_indicators(arrays.withColumn("t-a", F.lit(1)), "t", ["a"])
    with pytest.raises(ValueError):
        array_indicators(spark.range(1).withColumn("t", F.array(F.lit(1))), "t", ["a"])


def test_cast_by_role(spark):
    df = spark.createDataFrame(
        [("x", "31-12-2020", "7", "p"), ("y", "2020-12-31", "7.5", None), (None, None, "no", "q")],
        "s string, d string, n string, r string",
    )
    entries = {
        "s": {"type": "string", "values": ["x"]},
        "d": {"type": "date", "format": "dd-MM-yyyy"},
        "n": {"type": "int"},
        "r": {"type": "string"},
    }
    out = cast_by_role(df, entries)
    assert out.columns == ["s_quali", "d_date", "n_quanti", "r_quali"]
    assert [tuple(r) for r in out.collect()] == [
        ("x", date(2020, 12, 31), 7, "p"), ("null", None, None, None), ("null", None, None, "q"),
    ]
    assert out.schema["d_date"].metadata == {"d": {"type": "date", "format": "dd-MM-yyyy"}}
    tagged = df.withMetadata("r", {"k": 1})
    assert cast_by_role(tagged, entries).schema["r_quali"].metadata == {"k": 1}


@pytest.mark.parametrize("entries", [{}, {"s": {"type": "date"}}, {"s": {"type": None}}])
def test_cast_needs_an_entry(spark, entries):
    with pytest.raises(ValueError):
        cast_by_role(spark.createDataFrame([("x",)], "s string"), entries)


def test_whitelist_by_join_equals_the_list_form(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "s string")
    allowed = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert sorted(r["o"] for r in whitelist_by_join(df, "s", allowed, "o").collect()) == ["a", "a", "null", "null"]


def test_date_to_long(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:00:00.1239' AS n, timestamp'2024-01-01 00:00:00.1239' AS z,"
        " cast(null AS timestamp) AS e, 1 AS i"
    )
    out = date_to_long(date_to_long(date_to_long(df, "n", "a"), "z", "b"), "e", "c").first()
    assert (out["a"], out["b"], out["c"]) == (1704067200123, 1704067200123, None)
    with pytest.raises(ValueError):
        date_to_long(df, "i", "x")
    with pytest.raises(ValueError):
        date_to_long(df, "n", "i")


def test_zoneless_times_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-07-01 00:00:00' AS n, date'2024-07-01' AS d")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert date_to_long(df, "n", "a").first()["a"] == 1719792000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("2020-02-28", "2021-03-01", (1, 13, 53, 367, 31708800)),
        ("2020-12-31", "2021-01-01", (1, 1, 1, 1, 86400)),
        ("2020-01-01", "2020-01-01", (0, 0, 0, 0, 0)),
        ("2020-01-02", "2020-01-01", (None,) * 5),
    ],
)
def test_date_span(spark, a, b, expected):
    df = spark.sql(f"SELECT date'{a}' AS a, date'{b}' AS b")
    assert tuple(date_span(df, "a", "b").first())[2:] == expected


def test_started_days_count(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00' AS a, timestamp_ntz'2020-01-08 00:00:00.5' AS b")
    assert tuple(date_span(df, "a", "b").first())[2:] == (0, 0, 2, 8, 604800)


@pytest.mark.parametrize(
    "dates, name, values",
    [
        (["1950-05-01", "1985-01-01", None], "d_year_quali", [0, 17, None]),
        (["2015-05-01", "2020-01-01", None], "d_year_quanti", [2015, 2020, None]),
        (["2020-01-15", "2020-12-01", None], "d_month_quali", ["2020-1", "2020-12", None]),
        (["2020-01-01", "2020-02-03", None], "d_week_quanti", [1, 6, None]),
        (["2020-02-01", "2020-02-10", None], "d_day_quanti", [32, 41, None]),
        ([None, None], "d_day_quanti", [None, None]),
    ],
)
def test_date_bucketize(spark, dates, name, values):
    data = [(i, date.fromisoformat(d) if d else None) for i, d in enumerate(dates)]
    out = date_bucketize(spark.createDataFrame(data, "id int, d date"), ["d"])
    assert out.columns == ["id", "d", name]
    assert [r[name] for r in out.orderBy("id").collect()] == values


def test_buckets_of_several_dates_take_one_job(spark):
    df = spark.createDataFrame([(date(1950, 1, 1), datetime(2020, 1, 1)), (date(2020, 1, 1), datetime(2020, 1, 3))], "a date, b timestamp")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = fit_date_buckets(df, ["a", "b"])
    assert [b.granularity for b in found] == ["year_bin", "day"]
    # adaptive execution may run the stages of one query as two jobs
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 2


def test_split_by_role(spark):
    df = spark.sql(
        "SELECT 'a' AS s, 1 AS n, 1.5BD AS m, timestamp_ntz'2020-01-01 00:00:00' AS t, current_date() AS d,"
        " array('x') AS l, true AS b"
    )
    assert split_by_role(df) == {
        "string": ["s"], "numeric": ["n", "m"], "timestamp": ["t"], "date": ["d"], "array": ["l"], "other": ["b"],
    }
