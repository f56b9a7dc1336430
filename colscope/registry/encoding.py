"""Indexes, one-hot slots, bins, scaled vectors and the feature pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from colscope.operators import encode
from colscope.registry import query, table


def _index_sql(c: str, t: str) -> str:
    return f"""(SELECT {c} AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1
 AS DOUBLE) AS i FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"""


_QUALI = ["o_orderstatus", "o_orderpriority"]


@query(
    "string_index",
    f"""SELECT o_orderkey, a.i AS "o_orderstatus-index", b.i AS "o_orderpriority-index" FROM orders
 JOIN {_index_sql("o_orderstatus", "orders")} a ON o_orderstatus = a.label
 JOIN {_index_sql("o_orderpriority", "orders")} b ON o_orderpriority = b.label""",
)
def string_index(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", *_QUALI)
    return encode.string_index(df, _QUALI).drop(*_QUALI)


@query(
    "string_index_join",
    f"""SELECT o_orderkey, a.i AS "o_custkey-index", b.i AS "o_orderpriority-index" FROM orders
 JOIN {_index_sql("o_custkey", "orders")} a ON o_custkey = a.label
 JOIN {_index_sql("o_orderpriority", "orders")} b ON o_orderpriority = b.label""",
)
def string_index_join(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = encode.index_by_join(df, ["o_custkey", "o_orderpriority"])
    return out.drop("o_custkey", "o_orderpriority")


@query(
    "index_labels",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}-index' AS "column", label, i AS "index" FROM {_index_sql(c, "orders")}""" for c in _QUALI
    ),
)
def index_labels(spark, sf):
    return encode.index_labels(encode.string_index(table(spark, sf, "orders"), _QUALI))


@query(
    "label_ranks",
    f"""SELECT 'o_custkey' AS "column", CAST(label AS VARCHAR) AS label, i AS "index"
 FROM {_index_sql("o_custkey", "orders")}
 UNION ALL SELECT 'o_orderstatus', label, i FROM {_index_sql("o_orderstatus", "orders")}""",
)
def label_ranks(spark, sf):
    return encode.rank_labels(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]).drop("count")


@query(
    "one_hot",
    f"""SELECT o_orderkey, CAST(s.i AS INTEGER) AS slot, CASE WHEN s.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
 FROM orders JOIN {_index_sql("o_orderpriority", "orders")} b ON o_orderpriority = b.label,
 (SELECT i FROM {_index_sql("o_orderpriority", "orders")}) s""",
)
def one_hot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    df = encode.one_hot(encode.string_index(df, ["o_orderpriority"]), ["o_orderpriority-index"])
    return encode.slots(df, "o_orderpriority-index-vec", "o_orderkey")


def _bin_sql(c: str, lo: str = "lo", hi: str = "hi") -> str:
    edges = [f"CASE WHEN {c} >= {lo} + (({hi} - {lo}) / 10) * {i} THEN 1 ELSE 0 END" for i in range(1, 10)]
    return f"CAST({' + '.join(edges)} AS DOUBLE)"


@query(
    "bucketize_10",
    f"""SELECT l_orderkey, {_bin_sql("l_quantity", "lo1", "hi1")} AS "l_quantity-bucketized",
 {_bin_sql("l_extendedprice", "lo2", "hi2")} AS "l_extendedprice-bucketized" FROM lineitem,
 (SELECT min(l_quantity) AS lo1, max(l_quantity) AS hi1, min(l_extendedprice) AS lo2,
 max(l_extendedprice) AS hi2 FROM lineitem)""",
)
def bucketize_10(spark, sf):
    cols = ["l_quantity", "l_extendedprice"]
    df = table(spark, sf, "lineitem").select("l_orderkey", *cols)
    return encode.bucketize(df, cols).drop(*cols)


def _slots_sql(t: str, key: str, values: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {key}, CAST({i} AS INTEGER) AS slot, {v} AS value FROM {t}" for i, v in enumerate(values)
    )


@query("assemble", _slots_sql("events", "event_id", ["CAST(user_id AS DOUBLE)", "value"]))
def assemble(spark, sf):
    df = encode.assemble(table(spark, sf, "events"), ["user_id", "value"])
    return encode.slots(df, "features", "event_id")


def _scaled(c: str, t: str) -> str:
    return f"round(({c} - (SELECT min({c}) FROM {t})) / (SELECT CAST(max({c}) - min({c}) AS DOUBLE) FROM {t}), 6)"


@query(
    "minmax_scale",
    _slots_sql("orders", "o_orderkey", [_scaled("o_totalprice", "orders"), _scaled("o_custkey", "orders")]),
)
def minmax_scale(spark, sf):
    df = encode.assemble(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "numbers")
    df = encode.minmax_scale(df, "numbers", "scaled")
    return encode.slots(df, "scaled", "o_orderkey").withColumn("value", F.round("value", 6))


_HOT = """SELECT o_orderkey, CAST(s.i + {shift} AS INTEGER) AS slot,
 CASE WHEN s.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
 FROM orders JOIN {ix} b ON {c} = b.label, (SELECT i FROM {ix}) s"""


@query(
    "prepare_features",
    f"""{_HOT.format(shift="0", ix=_index_sql("o_orderstatus", "orders"), c="o_orderstatus")}
 UNION ALL {_HOT.format(shift="(SELECT count(DISTINCT o_orderstatus) FROM orders)",
                        ix=_index_sql("o_orderpriority", "orders"), c="o_orderpriority")}
 UNION ALL SELECT o_orderkey, CAST((SELECT count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority)
 FROM orders) AS INTEGER) AS slot, {_scaled("o_totalprice", "orders")} AS value FROM orders""",
)
def prepare_features(spark, sf):
    df = table(spark, sf, "orders")
    frame, _ = encode.prepare_features(df, _QUALI, ["o_totalprice"], keep=["o_orderkey"])
    return encode.slots(frame, "features", "o_orderkey").withColumn("value", F.round("value", 6))


@query(
    "prepare_features_codes",
    f"""SELECT o_orderkey, a.i AS "o_orderstatus-index", b.i AS "o_orderpriority-index",
 {_bin_sql("o_totalprice")} AS "o_totalprice-bucketized" FROM orders
 JOIN {_index_sql("o_orderstatus", "orders")} a ON o_orderstatus = a.label
 JOIN {_index_sql("o_orderpriority", "orders")} b ON o_orderpriority = b.label,
 (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""",
)
def prepare_features_codes(spark, sf):
    df = table(spark, sf, "orders")
    frame, _ = encode.prepare_features(df, _QUALI, ["o_totalprice"], keep=["o_orderkey"])
    return frame.drop("features")


@query(
    "index_labels_wide",
    """WITH n AS (SELECT 'customer-index' AS "column", CAST(o_custkey AS VARCHAR) AS label, count(*) AS n FROM orders GROUP BY 2
 UNION ALL SELECT 'o_orderpriority-index', o_orderpriority, count(*) FROM orders GROUP BY 2)
 SELECT "column", label, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, label) - 1 AS DOUBLE) AS index FROM n""",
)
def index_labels_wide(spark, sf):
    """Labels of an index with more of them than the driver may hold, beside one with few."""
    df = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer"), "o_orderpriority")
    return encode.index_labels(encode.string_index(df, ["customer", "o_orderpriority"], max_labels=10))
