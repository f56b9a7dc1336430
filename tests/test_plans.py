"""What the plans must and must not contain."""

import contextlib
import io

import pytest

import __spark_entry__ as entry_points
from colscope.operators.aggregates import pair_counts, terms_topk
from colscope.operators.entropy import entropy_profile
from colscope.operators.mixed import conditional_proba, value_distance

QUERIES = entry_points.queries()


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize(
    "name", ["entropy_profile", "value_distance", "significance", "mixed_distance", "terms_topk", "build_catalog", "string_index_join"]
)
def test_no_cross_join_and_no_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_scans_read_only_what_is_needed(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(entropy_profile(li, ["l_returnflag"]))
    assert "ReadSchema: struct<l_returnflag:string>" in text
    text = plan(pair_counts(li, ["l_returnflag", "l_linestatus"]))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in text


def test_ranking_is_limited_before_the_exchange(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert plan(terms_topk(part, ["p_name"])).count("WindowGroupLimit") >= 2


def test_pairs_are_counted_once(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = value_distance(conditional_proba(pair_counts(li, ["l_returnflag", "l_linestatus"])), 2)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in text
    assert text.count("FileScan") == 1


def test_bounds_of_numbers_and_dates_share_one_scan(spark, sf_dir):
    text = plan(entropy_profile(spark.read.parquet(f"{sf_dir}/orders.parquet")))
    assert "mergedValue" in text
