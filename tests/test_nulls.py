from pyspark.sql import functions as F

from colscope.operators.nulls import fill_by_role, fit_null_policy, null_policy, null_profile


def table(spark):
    """100 rows; column cNN holds NN values."""
    ids = spark.range(100).select(F.col("id").cast("int").alias("id"))

    def upto(n, value):
        return F.when(F.col("id") < n, value)

    return ids.select(
        "id",
        upto(40, F.lit("a")).alias("s40"),
        upto(50, F.lit("a")).alias("s50"),
        upto(79, F.col("id").cast("double")).alias("d79"),
        upto(60, F.array(F.lit("a"))).alias("l60"),
        upto(80, F.lit("a")).alias("s80"),
    )


def test_profile(spark):
    out = {r["column"]: (r["non_null"], r["total"], r["ratio"], r["action"]) for r in null_profile(table(spark)).collect()}
    assert out == {
        "id": (100, 100, 1.0, "drop_rows"), "s40": (40, 100, 0.4, "drop"), "s50": (50, 100, 0.5, "fill"),
        "d79": (79, 100, 0.79, "fill"), "l60": (60, 100, 0.6, "keep"), "s80": (80, 100, 0.8, "drop_rows"),
    }


def test_policy(spark):
    df = table(spark)
    out = null_policy(df)
    assert out.columns == ["id", "s50", "d79", "l60", "s80"]
    rows = {r["id"]: r for r in out.collect()}
    assert sorted(rows) == list(range(80))
    assert (rows[49]["s50"], rows[50]["s50"]) == ("a", "null")
    assert (rows[78]["d79"], rows[79]["d79"]) == (78.0, 2809.0)
    assert rows[70]["l60"] is None
    plan = fit_null_policy(df)
    assert (plan.dropped, plan.filled, plan.required) == (["s40"], ["s50", "d79"], ["id", "s80"])


def test_nan_is_present_for_the_share_but_filled_or_dropped(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (2.0, float("nan")), (None, 4.0)], "a double, b double")
    out = null_policy(df)
    assert sorted(tuple(r) for r in out.collect()) == [(1.0, 1.0), (2809.0, 2.0), (2809.0, 4.0)]


def test_empty_table_is_left_alone(spark):
    df = table(spark).limit(0)
    assert {r["action"] for r in null_profile(df).collect()} == {"none"}
    assert null_policy(df).columns == df.columns


def test_policy_is_stable_once_applied(spark):
    df = table(spark).drop("l60")
    once = null_policy(df)
    assert sorted(map(tuple, null_policy(once).collect())) == sorted(map(tuple, once.collect()))


def test_fill_by_role(spark):
    df = spark.createDataFrame([("a", 1, 1.5), (None, None, None)], "s string, i int, d double")
    out = fill_by_role(df, ["s"], ["i", "d"])
    assert [t for _, t in out.dtypes] == ["string", "double", "double"]
    assert [str(tuple(r)) for r in out.orderBy(F.desc("s")).collect()] == ["('null', nan, nan)", "('a', 1.0, 1.5)"]


def test_metadata_survives_a_fill(spark):
    df = table(spark).withMetadata("s50", {"k": 1})
    assert null_policy(df).schema["s50"].metadata == {"k": 1}
