"""Sources, catalogs and casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.typing import cast_by_role, date_to_long, whitelist_by_join
from colscope.registry import query, table
from colscope.session import scratch_path
from colscope.sources import catalog as cat
from colscope.sources.tables import read_csv, read_table

_ORDER_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _catalog_of(df: DataFrame, terms: int = 30) -> DataFrame:
    """Describe a table, write the JSON document, and read it back as a catalog."""
    path = scratch_path(df.sparkSession, "catalog")
    cat.catalog_document(df, terms=terms).write.text(path)
    return cat.read_catalog(df.sparkSession, path)


def _orders_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog_of(table(spark, sf, "orders").select(*_ORDER_COLS))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("data-type"),
        F.col("value").alias("data-value"),
        F.col("ts").alias("data-ts"),
        F.struct("props").alias("data-raw"),
    )


def _metric_sql(column: str, kind: str, src: str) -> str:
    x = f"(epoch_us({column}) // 1000)" if kind == "date" else column
    bounded = kind in ("number", "date")
    lo = f"CAST(min({x}) AS DOUBLE)" if bounded else "CAST(NULL AS DOUBLE)"
    hi = f"CAST(max({x}) AS DOUBLE)" if bounded else "CAST(NULL AS DOUBLE)"
    mean = f"round(CAST(avg({column}) AS DOUBLE), 4)" if kind == "number" else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, {lo} AS min_value, {hi} AS max_value,
 {mean} AS avg, CAST(count(*) - count({column}) AS BIGINT) AS empty_lines,
 CAST(count(DISTINCT {column}) AS BIGINT) AS values_count, CAST(1 AS DOUBLE) AS avg_values_count
 FROM {src}"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


_ORDER_KINDS = ["number", "terms", "number", "date", "terms"]


@query(
    "csv_scan",
    """SELECT p_partkey AS p_partkey_quanti, p_name AS p_name_quali, p_brand AS p_brand_quali,
 p_type AS p_type_quali, p_size AS p_size_quanti, p_retailprice AS p_retailprice_quanti FROM part""",
)
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "part").write.option("header", True).csv(path)
    kinds = {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
        "p_size": "int", "p_retailprice": "double",
    }
    return cast_by_role(read_csv(spark, path), {c: {"type": t} for c, t in kinds.items()})


@query(
    "array_field_scan",
    """SELECT event_type AS term, CAST(count(*) AS BIGINT) AS n FROM events
 WHERE event_type IS NOT NULL GROUP BY 1""",
)
def array_field_scan(spark, sf):
    df = read_table(spark, "parquet", f"{sf.rstrip('/')}/events.parquet", array_cols=["event_type"])
    return df.select(F.explode("event_type").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "catalog_scan",
    "SELECT *, CASE WHEN type = 'terms' THEN false END AS is_multi FROM ("
    + _union([_metric_sql(c, k, "orders") for c, k in zip(_ORDER_COLS, _ORDER_KINDS)])
    + ")",
)
def catalog_scan(spark, sf):
    return _orders_catalog(spark, sf).select(
        "column", "type", "min_value", "max_value", F.round("avg", 4).alias("avg"), "empty_lines",
        "values_count", "avg_values_count", "is_multi",
    )


@query(
    "catalog_values",
    _union(
        [
            f"""SELECT '{c}' AS "column", {c} AS term, CAST(count(*) AS BIGINT) AS "count"
 FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in ("o_orderstatus", "o_orderpriority")
        ]
        + [
            """SELECT 'p_name' AS "column", p_name AS term, CAST(count(*) AS BIGINT) AS "count"
 FROM part WHERE p_name IS NOT NULL GROUP BY p_name"""
        ]
    ),
)
def catalog_values(spark, sf):
    c = _orders_catalog(spark, sf)
    parts = _catalog_of(table(spark, sf, "part").select("p_name", "p_size"), terms=10_000)
    found = cat.col_values(c, "o_orderstatus").unionByName(cat.col_values(c, "o_orderpriority"))
    return found.unionByName(cat.col_values(parts, "p_name"))


@query(
    "catalog_bounding_box",
    """SELECT 'place' AS "column", max(c_acctbal) AS "top", CAST(min(c_nationkey) AS DOUBLE) AS "left",
 min(c_acctbal) AS "bottom", CAST(max(c_nationkey) AS DOUBLE) AS "right" FROM customer""",
)
def catalog_bounding_box(spark, sf):
    """Measured, written to the document and read back."""
    place = F.struct(F.col("c_acctbal").alias("lat"), F.col("c_nationkey").alias("lon"))
    found = _catalog_of(table(spark, sf, "customer").select(place.alias("place"), "c_mktsegment"))
    return found.where(F.col("type") == "coordinates").select("column", "bounding_box.*")


@query(
    "flow_from_catalog",
    """SELECT o_orderstatus AS o_orderstatus_quali, o_totalprice AS o_totalprice_quanti,
 CAST(o_orderdate AS DATE) AS o_orderdate_date, o_orderpriority AS o_orderpriority_quali,
 CAST(o_custkey AS DOUBLE) AS o_custkey_quanti FROM orders""",
)
def flow_from_catalog(spark, sf):
    """A catalog written from the table casts the same table."""
    df = table(spark, sf, "orders").select(*_ORDER_COLS)
    return cast_by_role(df, cat.entries(_orders_catalog(spark, sf)))


_PATHS = [("o_totalprice", "metrics.maxValue"), ("o_custkey", "metrics.valuesCount"), ("o_orderdate", "label")]


@query(
    "catalog_lookup",
    """SELECT 'o_totalprice' AS "column", 'metrics.maxValue' AS path, max(o_totalprice) AS value FROM orders
 UNION ALL SELECT 'o_custkey', 'metrics.valuesCount', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders
 UNION ALL SELECT 'o_orderdate', 'label', CAST(NULL AS DOUBLE)""",
)
def catalog_lookup(spark, sf):
    c = _orders_catalog(spark, sf)
    found = reduce(DataFrame.unionByName, [cat.col_info(c, col, path) for col, path in _PATHS])
    return found.withColumn("value", F.col("value").cast("double"))


@query(
    "clean_columns",
    """SELECT event_type AS "data-type", value AS "data-value", ts AS "data-ts" FROM events""",
)
def clean_columns(spark, sf):
    df = _events(spark, sf)
    return cat.clean_columns(df, _catalog_of(df))


@query(
    "quali_columns",
    """SELECT 'data-type' AS "column", 'terms' AS type, false AS is_multi,
 CAST(count(DISTINCT event_type) AS BIGINT) AS values_count FROM events""",
)
def quali_columns(spark, sf):
    c = _catalog_of(_events(spark, sf))
    return cat.quali_columns(c).select("column", "type", "is_multi", "values_count")


_LINE_KINDS = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number",
    "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
    "l_returnflag": "terms", "l_linestatus": "terms", "l_shipdate": "date",
}


@query("build_catalog", _union([_metric_sql(c, k, "lineitem") for c, k in _LINE_KINDS.items()]))
def build_catalog(spark, sf):
    out = cat.build_catalog(table(spark, sf, "lineitem"))
    return out.drop("bounding_box").withColumn("avg", F.round("avg", 4))


@query(
    "cast_quali_whitelist",
    """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN p_type ELSE 'null' END
 AS p_type_quali, p_brand AS p_brand_quali FROM part""",
)
def cast_quali_whitelist(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    entries = {
        "p_type": {"type": "string", "values": ["ECONOMY", "PROMO", "SMALL"]},
        "p_brand": {"type": "string"},
    }
    return cast_by_role(df, entries, ["p_type", "p_brand"])


@query(
    "cast_quali_whitelist_join",
    """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END
 AS cust_quali FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""",
)
def cast_quali_whitelist_join(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"))
    allowed = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    allowed = allowed.select(F.col("c_custkey").cast("string").alias("k"))
    return whitelist_by_join(orders, "cust", allowed, "cust_quali").drop("cust")


@query(
    "cast_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ordered_date, CAST(NULL AS DATE) AS priority_date
 FROM orders""",
)
def cast_date(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("ordered"),
        F.col("o_orderpriority").alias("priority"),
    )
    as_date = {"type": "date", "format": "dd-MM-yyyy"}
    return cast_by_role(df, {"ordered": as_date, "priority": as_date}, ["ordered", "priority"])


@query(
    "cast_quanti",
    """SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_size END AS size_quanti,
 p_retailprice AS price_quanti, CAST(p_retailprice AS DECIMAL(12,2)) AS exact_quanti FROM part""",
)
def cast_quanti(spark, sf):
    p = table(spark, sf, "part")
    mixed = F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    price = F.col("p_retailprice").cast("string")
    df = p.select("p_partkey", mixed.alias("size"), price.alias("price"), price.alias("exact"))
    kinds = {"size": "int", "price": "double", "exact": "decimal(12,2)"}
    return cast_by_role(df, {c: {"type": t} for c, t in kinds.items()}, list(kinds))


@query("date_to_long", "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events")
def date_to_long_query(spark, sf):
    return date_to_long(table(spark, sf, "events").select("event_id", "ts"), "ts", "ts_ms").drop("ts")
