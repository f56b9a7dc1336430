import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from colscope.operators import aggregates
from colscope.operators.aggregates import column_blocks, combined_agg, pair_counts, stats_agg, terms_topk, value_counts
from colscope.operators.encode import string_index


def test_ties_at_the_last_rank_go_by_term(spark):
    data = [(f"t{i:02d}",) for i in range(40)] + [("t39",)]
    out = terms_topk(spark.createDataFrame(data, "x string"), ["x"]).orderBy("rank").collect()
    assert [r["term"] for r in out] == ["t39"] + [f"t{i:02d}" for i in range(29)]
    assert [r["count"] for r in out] == [2] + [1] * 29


def test_an_array_counts_each_term_once_per_row(spark):
    df = spark.createDataFrame([(["a", "a", "b"], "x"), (["a", None], None), (None, "x")], "t array<string>, s string")
    out = {(r["field"], r["term"]): r["count"] for r in terms_topk(df, ["t", "s"]).collect()}
    assert out == {("t", "a"): 2, ("t", "b"): 1, ("s", "x"): 2}


def test_large_k_gives_the_same_as_sorting(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "GROUP_LIMIT", 3)
    data = [(str(i * i % 97),) for i in range(500)]
    out = terms_topk(spark.createDataFrame(data, "x string"), ["x"], 20).orderBy("rank").collect()
    expected = sorted(Counter(x for (x,) in data).items(), key=lambda p: (-p[1], p[0]))[:20]
    assert [(r["term"], r["count"]) for r in out] == expected


def test_stats_leave_out_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, 2.0), (None, float("nan")), (3, 4.0)], "i int, d double")
    out = {r["field"]: tuple(r)[1:] for r in stats_agg(df, ["i", "d"]).collect()}
    assert out == {"i": (2, 1.0, 3.0, 2.0, 4.0), "d": (2, 2.0, 4.0, 3.0, 6.0)}
    with pytest.raises(ValueError):
        stats_agg(spark.createDataFrame([("a",)], "s string"), ["s"])


def test_combined(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "s string, n int")
    out = {(r["field"], r["kind"]): r["body_json"] for r in combined_agg(df, ["s"], ["n"]).collect()}
    assert out == {
        ("s", "terms"): '{"buckets":[{"key":"a","doc_count":2},{"key":"b","doc_count":1}]}',
        ("n", "stats"): '{"count":3,"min":1.0,"max":3.0,"avg":2.0,"sum":6.0}',
    }


def test_value_counts_with_odd_names(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None)], ["premier contact ?", "v.w`"])
    out = {(r["column"], r["value"]): r["count"] for r in value_counts(df, df.columns).collect()}
    assert out == {("premier contact ?", "a"): 2, ("v.w`", "x"): 1}


def brute_pairs(rows, cols):
    out = Counter()
    for r in rows:
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                if i != j and r[i] is not None and r[j] is not None:
                    out[a, b, r[i], r[j]] += 1
    return out


def test_pair_counts(spark):
    cols = ["a", "b", "c"]
    data = [(str(i % 3), str(i % 2) if i % 5 else None, str(i % 4)) for i in range(60)]
    df = spark.createDataFrame(data, "a string, b string, c string")
    found = {(r["ci"], r["cj"], r["vi"], r["vj"]): r["count"] for r in pair_counts(df, cols).collect()}
    assert found == brute_pairs(data, cols)


def test_pair_counts_by_whole_tuples_agree(spark, monkeypatch):
    data = [(str(i % 3), str(i % 2), str(i * i % 5)) for i in range(200)]
    df = string_index(spark.createDataFrame(data, "a string, b string, c string"), ["a", "b", "c"])
    cols = ["a-index", "b-index", "c-index"]
    whole = sorted(map(tuple, pair_counts(df, cols).collect()))
    monkeypatch.setattr(aggregates, "TUPLE_LIMIT", 0)
    assert sorted(map(tuple, pair_counts(df, cols).collect())) == whole


def test_pair_counts_need_two_distinct_columns(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    for cols in (["a"], ["a", "a"], ["a", "z"]):
        with pytest.raises(ValueError):
            pair_counts(df, cols)


def nominal(df, arities):
    """Columns with the number of their categories in their metadata, where it is given."""
    meta = [{"ml_attr": {"type": "nominal", "num_vals": a}} if a else {} for a in arities]
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=m) for c, m in zip(df.columns, meta)])


def test_blocks_hold_few_combinations():
    blocks = column_blocks([2, None, 9, 2, 5000, 2, 30, 2, 2, 2, 2, 2])
    assert sorted(k for b in blocks for k in b) == list(range(12))
    assert [1] in blocks and [4] in blocks
    arities = [2, 1, 9, 2, 1, 2, 30, 2, 2, 2, 2, 2]
    for b in blocks:
        product = 1
        for k in b:
            product *= arities[k] + 1
        assert product <= 1000
    assert len(column_blocks([2] * 100)) == 17


@pytest.mark.parametrize("unknown", [0, 3])
def test_a_hundred_columns_are_counted_by_blocks(spark, unknown):
    rng = random.Random(4)
    rows = [tuple(rng.choice([0.0, 1.0, None]) for _ in range(100)) for _ in range(60)]
    names = ["a.b", *[f"x{k}" for k in range(1, 100)]]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names))
    counted = pair_counts(nominal(df, [None] * unknown + [2] * (100 - unknown)), names)
    assert counted.columns == ["ci", "cj", "vi", "vj", "count"]
    expected = Counter()
    for r in rows:
        expected.update((names[i], names[j], r[i], r[j]) for i, j in permutations(range(100), 2) if r[i] is not None and r[j] is not None)
    assert {tuple(r)[:4]: r["count"] for r in counted.collect()} == expected


def test_blocks_of_unlike_columns_agree_with_the_plain_way(spark):
    df = spark.range(400).selectExpr(
        *[f"cast(id % {k} as int) as i{k}" for k in (3, 7, 11)], *[f"cast(id % {k} as string) as s{k}" for k in (5, 9, 13)],
        "nullif(id % 6, 2) as n", "id % 10 as m", "id % 4 as o", "cast(id as string) as wide",
    )
    plain = {tuple(r) for r in pair_counts(df, df.columns).collect()}
    known = nominal(df, [3, 7, 11, 5, 9, 13, 6, 10, 4, None])
    assert {tuple(r) for r in pair_counts(known, df.columns).collect()} == plain
    assert pair_counts(known.limit(0), df.columns).count() == 0
