import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from colscope.functions.dates import fit_date_buckets
from colscope.operators.datecounts import buckets_of_counts, date_bounds, date_counts, entropy_of_counts, merge_date_counts
from colscope.operators.entropy import entropy_date

NAMES = ["a.b", "long", "short", "one", "none"]
SCHEMA = ", ".join(f"`{c}` date" for c in NAMES) + ", part int"


def frame(spark, n=400):
    rng = random.Random(2)
    start = date(1965, 3, 2)
    rows = []
    for _ in range(n):
        a = start + timedelta(days=rng.randrange(900))
        rows.append((a if rng.random() < 0.8 else None, start + timedelta(days=rng.randrange(20_000)), start + timedelta(days=rng.randrange(9)), start, None, rng.randrange(4)))
    return spark.createDataFrame(rows, SCHEMA)


def scores(df):
    return {r["column"]: (r["n"], r["classes"], pytest.approx(r["entropy"])) for r in df.collect()}


@pytest.mark.parametrize("monday_rule", [True, False])
def test_merged_parts_score_as_all_rows(spark, monday_rule):
    df = frame(spark)
    counts = merge_date_counts(*[date_counts(df.where(F.col("part") == p), NAMES) for p in range(4)])
    assert scores(entropy_of_counts(counts, NAMES, monday_rule)) == scores(entropy_date(df, NAMES, monday_rule))
    assert buckets_of_counts(counts, NAMES) == fit_date_buckets(df, NAMES)


def test_new_rows_change_bounds_and_buckets(spark):
    old = spark.createDataFrame([(date(2024, 1, 2),), (date(2024, 1, 9),)], "d date")
    new = spark.createDataFrame([(date(1980, 5, 5),), (None,), (date(2024, 1, 9),)], "d date")
    first = date_counts(old, ["d"])
    assert [b.granularity for b in buckets_of_counts(first, ["d"])] == ["day"]
    both = merge_date_counts(first, date_counts(new, ["d"]))
    assert date_bounds(both).collect() == [("d", date(1980, 5, 5), date(2024, 1, 9), 4)]
    assert {(r["day"], r["n"]) for r in both.collect()} == {(date(2024, 1, 2), 1), (date(2024, 1, 9), 2), (date(1980, 5, 5), 1)}
    assert buckets_of_counts(both, ["d"]) == fit_date_buckets(old.union(new), ["d"])


def test_empty_tables_and_other_types(spark):
    empty = spark.createDataFrame([], "d date, t timestamp")
    assert scores(entropy_of_counts(date_counts(empty, ["d"]), ["d"])) == scores(entropy_date(empty, ["d"]))
    assert date_counts(empty, []).collect() == []
    with pytest.raises(ValueError):
        date_counts(empty, ["t"])
    with pytest.raises(ValueError):
        merge_date_counts()
