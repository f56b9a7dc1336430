"""Term counts, statistics and entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from colscope.operators.aggregates import combined_agg, stats_agg, terms_topk, value_counts
from colscope.operators.datecounts import date_bounds, date_counts, entropy_of_counts, merge_date_counts
from colscope.operators.entropy import (
    entropy_categorical,
    entropy_date,
    entropy_date_levels,
    entropy_numeric,
    entropy_profile,
)
from colscope.registry import query, table


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _top_sql(source: str, size: int = 30) -> str:
    return f"""SELECT field, term, CAST(n AS BIGINT) AS "count", CAST(r AS BIGINT) AS rank FROM (
 SELECT field, term, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS r FROM (
 SELECT field, term, count(*) AS n FROM ({source}) WHERE term IS NOT NULL GROUP BY 1, 2)) WHERE r <= {size}"""


def _wide(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


_PART_FIELDS = ["p_name", "p_brand", "p_type"]


@query("terms_topk", _top_sql(_union([f"SELECT '{c}' AS field, {c} AS term FROM part" for c in _PART_FIELDS])))
def terms_topk_query(spark, sf):
    return _wide(terms_topk(table(spark, sf, "part"), _PART_FIELDS))


@query(
    "terms_topk_array",
    _top_sql(
        "SELECT 'words' AS field, term FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS term"
        " FROM documents)"
    ),
)
def terms_topk_array(spark, sf):
    df = table(spark, sf, "documents").select(F.split("text", " ").alias("words"))
    return _wide(terms_topk(df, ["words"]))


_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _stats_sql(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS field, CAST(count({c}) AS BIGINT) AS "count", CAST(min({c}) AS DOUBLE) AS "min",
 CAST(max({c}) AS DOUBLE) AS "max", round(CAST(avg({c}) AS DOUBLE), 4) AS "avg",
 round(CAST(sum({c}) AS DOUBLE), 2) AS "sum" FROM {t}"""


@query("stats_agg", _union([_stats_sql(c, "lineitem") for c in _STATS]))
def stats_agg_query(spark, sf):
    out = stats_agg(table(spark, sf, "lineitem"), _STATS)
    return out.withColumns({"avg": F.round("avg", 4), "sum": F.round("sum", 2)})


@query(
    "combined_agg",
    f"""SELECT field, 'terms' AS kind, term AS key, "count" AS n, CAST(NULL AS DOUBLE) AS lo,
 CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS total
 FROM ({_top_sql(_union([f"SELECT '{c}' AS field, {c} AS term FROM events" for c in ("event_type", "props")]))})
 UNION ALL SELECT field, 'stats', CAST(NULL AS VARCHAR), "count", "min", "max", "avg", "sum"
 FROM ({_stats_sql("value", "events")})""",
)
def combined_agg_query(spark, sf):
    # the JSON text is taken apart again, so that its content can be compared
    out = combined_agg(table(spark, sf, "events"), ["event_type", "props"], ["value"])
    bucket = F.from_json("body_json", "buckets array<struct<key:string,doc_count:bigint>>")["buckets"]
    stat = F.from_json("body_json", "count bigint, min double, max double, avg double, sum double")
    rows = out.select("field", "kind", stat.alias("s"), F.explode_outer(bucket).alias("b"))
    return rows.select(
        "field", "kind", F.col("b.key").alias("key"), F.coalesce("b.doc_count", "s.count").alias("n"),
        F.col("s.min").alias("lo"), F.col("s.max").alias("hi"),
        F.round("s.avg", 4).alias("mean"), F.round("s.sum", 2).alias("total"),
    )


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "value_counts",
    _union(
        [
            f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS "count"
 FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in _CATS
        ]
    ),
)
def value_counts_query(spark, sf):
    return value_counts(table(spark, sf, "lineitem"), _CATS)


def _score(counts: str, k: str) -> str:
    """Entropy, from a query giving ``c`` per class; ``k`` is the number of classes."""
    return f"""(SELECT round(coalesce(sum(-(c / n) * log2(c / n)), 0) / nullif(log2(max(k)), 0), 6) AS entropy
 FROM (SELECT CAST(c AS DOUBLE) AS c, sum(c) OVER () AS n, CAST({k} AS DOUBLE) AS k FROM ({counts})))"""


def _cat_sql(c: str, t: str) -> str:
    counts = f"SELECT count(*) AS c, count(*) OVER () AS kk FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    return f"""SELECT '{c}' AS "column", 'categorical' AS kind, CAST(count({c}) AS BIGINT) AS n,
 CAST(count(DISTINCT {c}) AS BIGINT) AS classes, {_score(counts, "kk")} AS entropy FROM {t}"""


def _num_sql(c: str, t: str) -> str:
    key = f"CASE WHEN hi - lo > 20 THEN least(floor(({c} - lo) / ((hi - lo) / 20.0)), 19) ELSE floor({c} - lo) END"
    k = f"""(SELECT CASE WHEN max({c}) - min({c}) > 20 THEN CAST(20 AS BIGINT)
 ELSE CAST(floor(max({c}) - min({c})) AS BIGINT) + 1 END FROM {t})"""
    counts = f"""SELECT count(*) AS c FROM (SELECT {key} AS b FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {t}),
 (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {t})) GROUP BY b"""
    return f"""SELECT '{c}' AS "column", 'numeric' AS kind, CAST(count({c}) AS BIGINT) AS n, {k} AS classes,
 {_score(counts, k)} AS entropy FROM {t}"""


_KEYS = {
    "year": "year({c})",
    "month": "year({c}) * 12 + month({c})",
    "week": "date_trunc('week', {c})",
    "day": "CAST({c} AS DATE)",
    "hour": "epoch_us({c}) // 3600000000",
    "minute": "epoch_us({c}) // 60000000",
    "second": "epoch_us({c}) // 1000000",
}


def _level_sql(c: str, t: str, level: str) -> str:
    key = _KEYS[level].format(c=c)
    counts = f"SELECT count(*) AS c, count(*) OVER () AS kk FROM {t} GROUP BY {key}"
    return f"""SELECT '{level}' AS granularity, CAST(count({c}) AS BIGINT) AS n,
 CAST(count(DISTINCT {key}) AS BIGINT) AS k, {_score(counts, "kk")} AS entropy FROM {t}"""


def _date_sql(c: str, t: str, levels: list[str]) -> str:
    return f"""SELECT '{c}' AS "column", 'date' AS kind, n, k AS classes, entropy FROM (
 {_union([_level_sql(c, t, lv) for lv in levels])}) ORDER BY entropy, k LIMIT 1"""


_LONG = ["year", "month", "week", "day"]
_MONDAY = ["day", "hour", "minute", "second"]
_LINE_DATE = _date_sql("l_shipdate", "lineitem", ["year", "month", "day"])


def _rounded(df):
    return df.withColumn("entropy", F.round("entropy", 6))


@query("entropy_categorical", _union([_cat_sql(c, "orders") for c in ("o_orderstatus", "o_orderpriority")]))
def entropy_categorical_query(spark, sf):
    return _rounded(entropy_categorical(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


_WIDE = ["l_extendedprice", "l_quantity", "l_orderkey"]


@query("entropy_numeric_wide", _union([_num_sql(c, "lineitem") for c in _WIDE]))
def entropy_numeric_wide(spark, sf):
    return _rounded(entropy_numeric(table(spark, sf, "lineitem"), _WIDE))


_NARROW = ["l_linenumber", "l_discount"]


@query("entropy_numeric_narrow", _union([_num_sql(c, "lineitem") for c in _NARROW]))
def entropy_numeric_narrow(spark, sf):
    return _rounded(entropy_numeric(table(spark, sf, "lineitem"), _NARROW))


@query("entropy_date", _date_sql("o_orderdate", "orders", _LONG))
def entropy_date_query(spark, sf):
    return _rounded(entropy_date(table(spark, sf, "orders"), ["o_orderdate"]))


@query("entropy_date_monday", _date_sql("ts", "events", _MONDAY))
def entropy_date_monday(spark, sf):
    return _rounded(entropy_date(table(spark, sf, "events"), ["ts"]))


@query("entropy_date_levels", _union([_level_sql("ts", "events", lv) for lv in _MONDAY]))
def entropy_date_levels_query(spark, sf):
    out = entropy_date_levels(table(spark, sf, "events"), ["ts"]).where("granularity is not null")
    return _rounded(out.drop("pos"))


def _profile_sql(parts: list[str]) -> str:
    return _union([f"SELECT CAST({i} AS INTEGER) AS position, * FROM ({p})" for i, p in enumerate(parts)])


@query(
    "entropy_profile",
    _profile_sql(
        [_num_sql(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
        + [_num_sql("l_linenumber", "lineitem")]
        + [_num_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice")]
        + [_num_sql(c, "lineitem") for c in ("l_discount", "l_tax")]
        + [_cat_sql(c, "lineitem") for c in ("l_returnflag", "l_linestatus")]
        + [_LINE_DATE]
    ),
)
def entropy_profile_query(spark, sf):
    return _rounded(entropy_profile(table(spark, sf, "lineitem")))


@query(
    "entropy_profile_orders",
    _profile_sql(
        [
            _num_sql("o_orderkey", "orders"), _num_sql("o_custkey", "orders"),
            _cat_sql("o_orderstatus", "orders"), _num_sql("o_totalprice", "orders"),
            _date_sql("o_orderdate", "orders", _LONG), _cat_sql("o_orderpriority", "orders"),
        ]
    ),
)
def entropy_profile_orders(spark, sf):
    return _rounded(entropy_profile(table(spark, sf, "orders")))


_GAPS = {
    "flag": "nullif(l_returnflag, 'N')",
    "line": "nullif(l_linenumber, 7)",
    "qty": "CASE WHEN l_linenumber <= 5 THEN l_quantity END",
    "ship": "CASE WHEN l_linenumber <= 4 THEN l_shipdate END",
}
_GAPS_SQL = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _GAPS.items()) + " FROM lineitem)"
_GAPS_DATE = f"(SELECT ship FROM {_GAPS_SQL} WHERE ship IS NOT NULL)"


def _present_sql(c: str, make) -> str:
    return make(c, f"(SELECT {c} FROM {_GAPS_SQL} WHERE {c} IS NOT NULL)")


@query(
    "entropy_profile_gaps",
    _profile_sql(
        [
            _present_sql("flag", _cat_sql), _present_sql("line", _num_sql), _present_sql("qty", _num_sql),
            _date_sql("ship", _GAPS_DATE, ["year", "month", "day"]),
        ]
    ),
)
def entropy_profile_gaps(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _GAPS.items()])
    return _rounded(entropy_profile(df))


@query("entropy_texts", _union([_cat_sql(c, "documents") for c in ("text", "lang", "source")]))
def entropy_texts(spark, sf):
    return _rounded(entropy_categorical(table(spark, sf, "documents"), ["text", "lang", "source"]))


def _counted(spark, sf):
    """Days of two tables' dates, one table counted part by part as its rows would arrive, and merged."""
    lines = table(spark, sf, "lineitem").selectExpr("coalesce(l_linestatus, '') AS status", "cast(l_shipdate AS date) AS l_shipdate")
    parts = [lines.where("status = 'O'"), lines.where("status = 'F'"), lines.where("status NOT IN ('O', 'F')")]
    orders = table(spark, sf, "orders").selectExpr("cast(o_orderdate AS date) AS o_orderdate")
    return merge_date_counts(date_counts(orders, ["o_orderdate"]), *[date_counts(p, ["l_shipdate"]) for p in parts])


def _days_sql(select: str) -> str:
    dates = {"l_shipdate": "lineitem", "o_orderdate": "orders"}
    return _union([f"""SELECT '{c}' AS "column", {select.format(d=f"CAST({c} AS DATE)", t=t)}""" for c, t in dates.items()])


@query("date_counts_merged", _days_sql("{d} AS day, count(*) AS n FROM {t} WHERE {d} IS NOT NULL GROUP BY {d}"))
def date_counts_merged(spark, sf):
    return _counted(spark, sf)


@query("date_bounds_merged", _days_sql("min({d}) AS first, max({d}) AS last, count({d}) AS n FROM {t}"))
def date_bounds_merged(spark, sf):
    return date_bounds(_counted(spark, sf))


@query("entropy_date_merged", f"SELECT * FROM ({_LINE_DATE}) UNION ALL SELECT * FROM ({_date_sql('o_orderdate', 'orders', _LONG)})")
def entropy_date_merged(spark, sf):
    return _rounded(entropy_of_counts(_counted(spark, sf), ["l_shipdate", "o_orderdate"]))
