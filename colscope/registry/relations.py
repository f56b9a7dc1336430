"""Random-forest relations between columns. Forests have no SQL counterpart; what must hold of their
importances has, and is what the queries return."""

from __future__ import annotations

from pyspark.sql import functions as F

from colscope.operators import encode
from colscope.operators.relations import column_relations
from colscope.plans.flows import analyse_relations, index_for_relations, prepare_mixed
from colscope.registry import query, table

_QUALI = ["l_returnflag", "l_linestatus"]
_NUMBERS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _encoded(spark, sf):
    df = table(spark, sf, "lineitem").select(*_QUALI, *_NUMBERS)
    return encode.string_index(df, _QUALI).drop(*_QUALI)


_COLS = ["l_returnflag-index", "l_linestatus-index", *_NUMBERS]


def _stated(df, tops: dict[str, str] | None = None):
    """What must hold of importances, one row per label: every other column listed once, ranks without
    gaps, no negative importance, a sum of one, the label itself absent; and the first column where a
    planted rule decides it."""
    tops = tops or {}
    top = F.max(F.when(F.col("rank") == 1, F.col("feature")))
    named = [F.lit(x) for x in tops] or [F.lit("")]
    return df.groupBy("label").agg(
        F.count_distinct("feature").alias("features"),
        F.min("rank").cast("bigint").alias("first_rank"),
        F.max("rank").cast("bigint").alias("last_rank"),
        F.count_distinct("rank").alias("ranks"),
        F.round(F.sum("importance"), 6).alias("importance"),
        F.count_if(F.col("importance") < 0).alias("negative"),
        F.count_if(F.col("feature") == F.col("label")).alias("own"),
        top.alias("top"),
    ).withColumn("top", F.when(F.col("label").isin(*named), F.col("top")))


def _stated_sql(labels: list[str], features: int, tops: dict[str, str] | None = None) -> str:
    rows = []
    for c in labels:
        top = f"'{tops[c]}'" if tops and c in tops else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"""SELECT '{c}' AS label, CAST({features} AS BIGINT) AS features, CAST(1 AS BIGINT) AS first_rank,
 CAST({features} AS BIGINT) AS last_rank, CAST({features} AS BIGINT) AS ranks, CAST(1 AS DOUBLE) AS importance,
 CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS own, {top} AS top WHERE (SELECT count(*) FROM lineitem) > 0"""
        )
    return " UNION ALL ".join(rows)


@query("rf_importance_class", _stated_sql(["l_returnflag-index"], 5))
def rf_importance_class(spark, sf):
    return _stated(column_relations(_encoded(spark, sf), _COLS, ["l_returnflag-index"]))


@query("rf_importance_regr", _stated_sql(["l_quantity"], 5))
def rf_importance_regr(spark, sf):
    return _stated(column_relations(_encoded(spark, sf), _COLS, ["l_quantity"]))


@query("column_relations", _stated_sql(_COLS, 5))
def column_relations_query(spark, sf):
    return _stated(column_relations(_encoded(spark, sf), _COLS))


_PLANTED = {"big-index": "l_quantity", "dear": "l_tax"}


@query("relations_planted", _stated_sql(list(_PLANTED), 5, _PLANTED))
def relations_planted(spark, sf):
    """A class made from the quantity and a number made from the tax: their first columns are known."""
    df = table(spark, sf, "lineitem").select(
        *_NUMBERS, F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("big"), (F.col("l_tax") * 100).alias("dear")
    )
    df = encode.string_index(df, ["big"]).drop("big")
    return _stated(column_relations(df, [*_NUMBERS, "big-index", "dear"], list(_PLANTED)), _PLANTED)


_ORDER_LABELS = ["o_orderstatus_quali_index", "o_orderpriority_quali_index", "o_totalprice_quanti"]


@query("analyse_relations", "SELECT label, first_rank, importance, negative, own FROM (" + _stated_sql(_ORDER_LABELS, 1) + ")")
def analyse_relations_query(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"),
    )
    entries = {
        "o_orderstatus": {"type": "string"},
        "o_orderpriority": {"type": "string", "values": ["1-URGENT", "2-HIGH"]},
        "o_totalprice": {"type": "double"},
        "o_orderdate": {"type": "date", "format": "MM/dd/yyyy"},
    }
    return _stated(analyse_relations(o, entries, _ORDER_LABELS)).select("label", "first_rank", "importance", "negative", "own")


_GAP_LABELS = ["flag_quali_index", "line_quanti", "tax_quanti"]


@query("relations_gaps", "SELECT label, first_rank, importance, negative, own FROM (" + _stated_sql(_GAP_LABELS, 1) + ")")
def relations_gaps(spark, sf):
    """Relations of columns with missing categories, missing numbers, and missing and unreadable dates."""
    df = table(spark, sf, "lineitem").selectExpr(
        "nullif(l_returnflag, 'N') AS flag",
        "CAST(nullif(l_linenumber, 7) AS STRING) AS line",
        "CASE WHEN l_returnflag = 'A' THEN CAST(l_tax AS STRING) END AS tax",
        "CASE WHEN l_linenumber = 1 THEN 'soon' WHEN l_linenumber <= 4 THEN date_format(l_shipdate, 'dd/MM/yyyy') END AS ship",
    )
    entries = {"flag": {"type": "terms"}, "line": {"type": "number"}, "tax": {"type": "number"}, "ship": {"type": "date", "format": "dd/MM/yyyy"}}
    return _stated(analyse_relations(df, entries, _GAP_LABELS)).select("label", "first_rank", "importance", "negative", "own")


@query(
    "relation_categories",
    """SELECT 'p_name_quali_index' AS "column", CAST(count(DISTINCT p_name) AS BIGINT) AS categories FROM part
 UNION ALL SELECT 'o_custkey_quali_index', CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders""",
)
def relation_categories(spark, sf):
    """Columns keep all their categories in the relation flow."""
    parts = []
    for name, column in (("part", "p_name"), ("orders", "o_custkey")):
        df = table(spark, sf, name).select(F.col(column).cast("string").alias(column))
        indexed, names = index_for_relations(df, {column: {"type": "string"}})
        parts.append(indexed.agg(F.count_distinct(F.col(names[0])).alias("categories")).select(F.lit(names[0]).alias("column"), "categories"))
    return parts[0].unionByName(parts[1])


@query(
    "prepare_mixed",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS w FROM part),
 ix AS (SELECT w, CAST(row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS DOUBLE) AS i FROM w GROUP BY w),
 tx AS (SELECT p_type, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS DOUBLE) AS i
 FROM part GROUP BY p_type)
 SELECT p_partkey, ix.i AS "words-str-index", tx.i AS "p_type-index" FROM w JOIN ix USING (w)
 JOIN part USING (p_partkey) JOIN tx USING (p_type)""",
)
def prepare_mixed_query(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", "p_retailprice", F.split("p_name", " ").alias("words")
    )
    out = prepare_mixed(df, keep=["p_partkey"])
    return out.frame.select("p_partkey", *[F.col(f"`{c}`") for c in out.index_columns])


_WIDE = {"side_index": "code_index", "height": "code_index"}


@query("relations_wide", _stated_sql(list(_WIDE), 4, _WIDE))
def relations_wide(spark, sf):
    """A class and a number, each missing in half of the rows, that follow from a code of up to 5,000 values; beside it a
    column with a value for every row."""
    code = F.col("l_orderkey") % 5000
    # what a code stands for has nothing to do with its size
    mixed = (code * 7919 + 13) % 4999
    half = F.col("l_linenumber") % 2 == 1
    df = table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), code.cast("string")).alias("code"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("unique"),
        "l_quantity",
        "l_tax",
        F.when(half, F.when(mixed < 1500, "low").when(mixed < 3200, "middle").otherwise("high")).alias("side"),
        F.when(half, mixed.cast("double") / 100).alias("height"),
    )
    names = ["code_index", "unique_index", "l_quantity", "l_tax"]
    df = encode.index_by_join(df, ["code", "unique", "side"], "_index")
    found = [column_relations(df, [*names, label], [label], numTrees=20) for label in _WIDE]
    return _stated(found[0].unionByName(found[1]), _WIDE)
