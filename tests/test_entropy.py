import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from colscope.operators.entropy import entropy_date, entropy_date_levels, entropy_numeric, entropy_profile


def score(counts, k):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) / math.log2(k)


def one(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    r = entropy_profile(df).first()
    return r["n"], r["classes"], r["entropy"]


def test_two_even_classes(spark):
    assert one(spark, ["a", "b", "a", "b", None], "string") == (4, 2, 1.0)
    assert one(spark, [True, False], "boolean") == (2, 2, 1.0)


def test_long_texts_differ_to_the_last_character(spark):
    long = "x" * 5000
    assert one(spark, [long + "a", long + "b", long + "a", long + "b", "s", "s"], "string") == (6, 3, 1.0)


def test_one_class_has_no_score(spark):
    assert one(spark, ["a", "a"], "string") == (2, 1, None)
    assert one(spark, [5.0, 5.0], "double") == (2, 1, None)


@pytest.mark.parametrize("kind", ["string", "double", "int", "date", "timestamp", "boolean"])
def test_no_values(spark, kind):
    assert one(spark, [None, None], kind) == (0, 0, 0.0)
    empty = spark.createDataFrame([], f"x {kind}")
    r = entropy_profile(empty).first()
    assert (r["column"], r["n"], r["entropy"]) == ("x", 0, 0.0)


def test_range_of_exactly_twenty_has_unit_bins(spark):
    values = [0.0, 0.5, 7.0, 20.0]
    n, k, e = one(spark, values, "double")
    assert (n, k) == (4, 21)
    assert e == pytest.approx(score([2, 1, 1], 21))


def test_range_above_twenty_has_twenty_bins(spark):
    n, k, e = one(spark, [0.0, 1.0, 10.0, 20.5, float("nan")], "double")
    assert (n, k) == (4, 20)
    # 0.0 and 1.0 share the first bin, which is 1.025 wide
    assert e == pytest.approx(score([2, 1, 1], 20))


def test_negative_numbers_and_decimals(spark):
    df = spark.sql("SELECT cast(x AS decimal(10,2)) AS x FROM VALUES (-50), (-50), (0), (50) AS t(x)")
    r = entropy_numeric(df, ["x"]).first()
    assert (r["classes"], r["entropy"]) == (20, pytest.approx(score([2, 1, 1], 20)))


def test_constant_date_scores_one(spark):
    assert one(spark, [date(2020, 1, 1)] * 3, "date") == (3, 1, 1.0)


def test_weeks_are_skipped_from_a_monday_on(spark):
    monday = [date(2024, 1, 1) + timedelta(days=i) for i in (0, 3, 3, 20)]
    df = spark.createDataFrame([(d,) for d in monday], "x date")
    levels = {r["granularity"] for r in entropy_date_levels(df, ["x"]).collect() if r["granularity"]}
    assert levels == {"day", "hour", "minute", "second"}
    every = {
        r["granularity"]
        for r in entropy_date_levels(df, ["x"], monday_rule=False).collect()
        if r["granularity"]
    }
    assert every == {"week", "day"}
    tuesday = spark.createDataFrame([(d + timedelta(days=1),) for d in monday], "x date")
    assert entropy_date(tuesday, ["x"]).first()["entropy"] == pytest.approx(score([3, 1], 2))


def test_times_within_one_day(spark):
    start = datetime(2024, 1, 1, 10, 0, 0)
    values = [start, start + timedelta(seconds=1), start + timedelta(seconds=90), start + timedelta(hours=2)]
    df = spark.createDataFrame([(v,) for v in values], "x timestamp_ntz")
    by = {r["granularity"]: r["entropy"] for r in entropy_date_levels(df, ["x"]).collect() if r["granularity"]}
    # all on one day: that granularity has a single class and no score
    assert by["day"] is None
    assert by["hour"] == pytest.approx(score([3, 1], 2))
    assert by["second"] == pytest.approx(1.0)
    assert entropy_date(df, ["x"]).first()["entropy"] == pytest.approx(score([3, 1], 2))


def test_dates_before_1970(spark):
    values = [date(1960, 5, 3), date(1960, 5, 3), date(1961, 8, 9)]
    _, _, e = one(spark, values, "date")
    assert e == pytest.approx(score([2, 1], 2))


def test_profile_keeps_column_order_and_names(spark):
    df = spark.createDataFrame([("a", 1, date(2020, 1, 1), "b")], ["z z", "a.b", "d", "q`q"])
    out = entropy_profile(df).orderBy("position").collect()
    assert [r["column"] for r in out] == ["z z", "a.b", "d", "q`q"]
    assert [r["kind"] for r in out] == ["categorical", "numeric", "date", "categorical"]


def test_unsupported_type(spark):
    with pytest.raises(ValueError):
        entropy_profile(spark.sql("SELECT array(1) AS x"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=40))
def test_scores_match_a_plain_count(spark, values):
    n, k, e = one(spark, values, "string")
    counts = Counter(values)
    assert (n, k) == (len(values), len(counts))
    if len(counts) == 1:
        assert e is None
    else:
        assert 0 <= e <= 1
        assert e == pytest.approx(score(counts.values(), len(counts)))


def test_a_hot_value_does_not_change_the_score(spark):
    rnd = random.Random(5)
    values = ["hot"] * 3000 + [str(rnd.randrange(500)) for _ in range(6000)]
    counts = Counter(values)
    assert one(spark, values, "string")[2] == pytest.approx(score(counts.values(), len(counts)))
