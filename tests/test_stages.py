from datetime import date, datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from colscope.operators.stages import (
    DateBuckets,
    EpochMillis,
    FirstTerm,
    NonNullIndexer,
    NullPolicy,
    RoleCaster,
    TermIndicators,
)


def test_pipeline_round_trip(spark, tmp_path):
    data = [
        (["a", "b"], "x", datetime(2020, 1, 1), date(2010, 1, 1), None),
        (["b"], "y", datetime(2020, 1, 2), date(2015, 1, 1), None),
        (["c"], "x", datetime(2020, 1, 3), date(2020, 1, 1), "q"),
    ]
    df = spark.createDataFrame(data, "t array<string>, s string, at timestamp, d date, mostly_null string")
    pipeline = Pipeline(
        stages=[
            NullPolicy(),
            FirstTerm(inputCol="t", terms=["a", "b"]),
            TermIndicators(inputCol="t", terms=["b"]),
            EpochMillis(inputCol="at", outputCol="at_ms"),
            DateBuckets(inputCols=["d"]),
            NonNullIndexer(inputCols=["s", "t-str"]),
        ]
    )
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    a, b = model.transform(df), back.transform(df)
    assert a.columns == b.columns == [
        "t", "s", "at", "d", "t-str", "t-b", "at_ms", "d_year_quanti", "s-index", "t-str-index",
    ]
    assert a.orderBy("at").collect() == b.orderBy("at").collect()
    first = b.orderBy("at").first()
    assert (first["t-str"], first["t-b"], first["d_year_quanti"], first["s-index"]) == ("a", True, 2010, 0.0)


def test_role_caster_round_trip(spark, tmp_path):
    stage = RoleCaster(inputCols=["s", "n"], entries={"s": {"type": "string", "values": ["x"]}, "n": {"type": "int"}})
    stage.write().overwrite().save(str(tmp_path / "caster"))
    back = RoleCaster.load(str(tmp_path / "caster"))
    df = spark.createDataFrame([("x", "1", "k"), ("y", "b", "k")], "s string, n string, other string")
    assert [tuple(r) for r in back.transform(df).collect()] == [("x", 1, "k"), ("null", None, "k")]


def test_null_policy_thresholds_are_parameters(spark):
    df = spark.range(10).select(F.when(F.col("id") < 7, F.col("id")).alias("x"))
    assert NullPolicy(dropBelow=0.9).fit(df).transform(df).columns == []
    assert NullPolicy(fillBelow=0.6).fit(df).transform(df).count() == 7


def test_null_policy_fills_are_the_callers(spark):
    df = spark.createDataFrame([("x", 1)] * 6 + [(None, None)] * 4, "s string, n int")
    out = NullPolicy(fillText="none", fillNumber=-1.0).fit(df).transform(df)
    assert {tuple(r) for r in out.collect()} == {("x", 1), ("none", -1)}
