"""Null handling, array flattening and dates."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from colscope.columns import rows_of, split_by_role
from colscope.functions.arrays import array_first_term, array_indicators
from colscope.functions.dates import date_bucketize, date_span
from colscope.functions.typing import cast_by_role
from colscope.operators import stages
from colscope.operators.aggregates import terms_topk
from colscope.operators.encode import fit_string_index
from colscope.operators.entropy import entropy_numeric
from colscope.operators.nulls import fill_by_role, null_policy, null_profile
from colscope.registry import query, table
from colscope.session import scratch_path
from colscope import streaming

# Columns with missing values in each band of the policy, made from other columns of the same row.
_GAPS = {
    "flag": "nullif(l_returnflag, 'N')",
    "line": "nullif(l_linenumber, 7)",
    "tax": "CASE WHEN l_returnflag = 'A' THEN l_tax END",
    "qty": "CASE WHEN l_linenumber <= 5 THEN l_quantity END",
    "ship": "CASE WHEN l_linenumber <= 4 THEN l_shipdate END",
}
_GAPS_SQL = "SELECT l_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _GAPS.items()) + " FROM lineitem"


def _gaps(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", *[f"{e} AS {n}" for n, e in _GAPS.items()])


def _profile_sql(columns: dict[str, bool], source: str) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) AS total,
 {str(fillable).upper()} AS fillable FROM ({source})"""
        for c, fillable in columns.items()
    ]
    return f"""SELECT "column", CAST(non_null AS BIGINT) AS non_null, CAST(total AS BIGINT) AS total,
 round(non_null * 1.0 / total, 6) AS ratio,
 CASE WHEN non_null * 1.0 / total < 0.5 THEN 'drop' WHEN non_null * 1.0 / total < 0.8
 THEN CASE WHEN fillable THEN 'fill' ELSE 'keep' END ELSE 'drop_rows' END AS action
 FROM ({" UNION ALL ".join(parts)})"""


@query(
    "null_profile",
    _profile_sql(
        {"l_orderkey": True, "flag": True, "line": True, "tax": True, "qty": True, "ship": False}, _GAPS_SQL
    ),
)
def null_profile_query(spark, sf):
    return null_profile(_gaps(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(
    "null_profile_joined",
    _profile_sql(
        {"lang": True, "source": True, "quality": True, "toxic": True},
        "SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    ),
)
def null_profile_joined(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    df = d.join(table(spark, sf, "labels"), "doc_id", "left").drop("doc_id")
    return null_profile(df).withColumn("ratio", F.round("ratio", 6))


@query(
    "null_policy",
    f"""SELECT l_orderkey, coalesce(flag, 'null') AS flag, line, coalesce(qty, 2809) AS qty, ship
 FROM ({_GAPS_SQL}) WHERE line IS NOT NULL AND l_orderkey IS NOT NULL""",
)
def null_policy_query(spark, sf):
    return null_policy(_gaps(spark, sf))


@query(
    "fill_by_role",
    f"""SELECT l_orderkey, coalesce(flag, 'null') AS flag, coalesce(CAST(line AS DOUBLE), -1) AS line,
 coalesce(tax, -1) AS tax FROM ({_GAPS_SQL})""",
)
def fill_by_role_query(spark, sf):
    df = _gaps(spark, sf).select("l_orderkey", "flag", "line", "tax")
    out = fill_by_role(df, ["flag"], ["line", "tax"])
    seen = {c: F.when(F.isnan(c), F.lit(-1.0)).otherwise(F.col(c)) for c in ("line", "tax")}
    return out.withColumns(seen)


@query(
    "index_non_null",
    f"""WITH g AS ({_GAPS_SQL}),
 ix AS (SELECT flag, row_number() OVER (ORDER BY count(*) DESC, flag) - 1 AS i FROM g
 WHERE flag IS NOT NULL GROUP BY flag)
 SELECT l_orderkey, g.flag AS flag, CAST(coalesce(i, (SELECT count(*) FROM ix)) AS DOUBLE) AS flag_index
 FROM g LEFT JOIN ix ON g.flag = ix.flag""",
)
def index_non_null(spark, sf):
    df = _gaps(spark, sf).select("l_orderkey", "flag")
    return fit_string_index(df, ["flag"], ["flag_index"], "keep").transform(df)


def _words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))


@query(
    "array_first_term",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part),
 t AS (SELECT term FROM (SELECT DISTINCT p_partkey, unnest(words) AS term FROM w)
 GROUP BY term ORDER BY count(*) DESC, term LIMIT 6)
 SELECT p_partkey, CASE WHEN words[1] IN (SELECT term FROM t) THEN words[1] ELSE 'others' END AS "words-str"
 FROM w""",
)
def array_first_term_query(spark, sf):
    df = _words(spark, sf)
    # six terms reach the driver
    allowed = [r["term"] for r in terms_topk(df, ["words"], 6).select("term").collect()]
    return array_first_term(df, "words", allowed).drop("words")


@query(
    "array_indicators",
    """SELECT p_partkey, list_contains(string_split(p_name, ' '), 'small') AS "words-small",
 list_contains(string_split(p_name, ' '), 'red') AS "words-red",
 list_contains(string_split(p_name, ' '), 'ring') AS "words-ring" FROM part""",
)
def array_indicators_query(spark, sf):
    return array_indicators(_words(spark, sf), "words", ["small", "red", "ring"]).drop("words")


_SPAN_SQL = """SELECT {key}, CAST(year(b) - year(a) AS BIGINT) AS years,
 CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS BIGINT) AS months,
 CAST(ceil(ceil((epoch_us(b) - epoch_us(a)) / 86400000000.0) / 7) AS BIGINT) AS weeks,
 CAST(ceil((epoch_us(b) - epoch_us(a)) / 86400000000.0) AS BIGINT) AS days,
 CAST(floor((epoch_us(b) - epoch_us(a)) / 1000000.0) AS BIGINT) AS seconds
 FROM (SELECT {key}, min({c}) AS a, max({c}) AS b FROM {t} GROUP BY {key})"""


def _span(spark, sf, t, key, c):
    df = table(spark, sf, t).groupBy(key).agg(F.min(c).alias("a"), F.max(c).alias("b"))
    return date_span(df, "a", "b").drop("a", "b")


@query("date_span", _SPAN_SQL.format(key="o_custkey", c="o_orderdate", t="orders"))
def date_span_query(spark, sf):
    return _span(spark, sf, "orders", "o_custkey", "o_orderdate")


@query("date_span_time", _SPAN_SQL.format(key="user_id", c="ts", t="events"))
def date_span_time(spark, sf):
    return _span(spark, sf, "events", "user_id", "ts")


@query(
    "date_span_order",
    """SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate <= l_shipdate
 THEN CAST(year(l_shipdate) - year(o_orderdate) AS BIGINT) END AS years, CASE WHEN o_orderdate <= l_shipdate
 THEN CAST(ceil((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) END AS days
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def date_span_order(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return date_span(df, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "years", "days")


# The whole table's dates, stretched or shrunk so that each granularity is reached.

@query(
    "date_bucket_year_bin",
    """WITH d AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) - to_months(CAST(60 * (l_linenumber - 1) AS INTEGER))
 AS d FROM lineitem), s AS (SELECT min(year(d)) AS lo, max(year(d)) AS hi FROM d)
 SELECT l_orderkey, CAST(floor((year(d) - lo) / ceil((hi - lo) / 30.0)) AS BIGINT) AS d_year_quali FROM d, s""",
)
def date_bucket_year_bin(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "add_months(cast(l_shipdate AS date), -60 * (l_linenumber - 1)) AS d"
    )
    return date_bucketize(df, ["d"]).drop("d")


@query("date_bucket_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year_quanti FROM orders")
def date_bucket_year(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return date_bucketize(df, ["o_orderdate"]).drop("o_orderdate")


def _shrunk(spark, sf, by):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"date_add(date'1995-01-01', cast(datediff(o_orderdate, date'1995-01-01') div {by} AS int)) AS d",
    )


def _shrunk_sql(by: int, value: str) -> str:
    return f"""SELECT o_orderkey, {value} FROM (SELECT o_orderkey, DATE '1995-01-01'
 + CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // {by} AS INTEGER) AS d FROM orders)"""


@query(
    "date_bucket_month",
    _shrunk_sql(10, "CAST(year(d) AS VARCHAR) || '-' || CAST(month(d) AS VARCHAR) AS d_month_quali"),
)
def date_bucket_month(spark, sf):
    return date_bucketize(_shrunk(spark, sf, 10), ["d"]).drop("d")


@query("date_bucket_week", "SELECT event_id, CAST(weekofyear(ts) AS BIGINT) AS ts_week_quanti FROM events")
def date_bucket_week(spark, sf):
    return date_bucketize(table(spark, sf, "events").select("event_id", "ts"), ["ts"]).drop("ts")


@query("date_bucket_day", _shrunk_sql(200, "CAST(dayofyear(d) AS BIGINT) AS d_day_quanti"))
def date_bucket_day(spark, sf):
    return date_bucketize(_shrunk(spark, sf, 200), ["d"]).drop("d")


@query(
    "null_policy_types",
    """SELECT l_orderkey, CAST(coalesce(CASE WHEN l_linenumber <= 4 THEN l_linenumber END, 2809) AS SMALLINT) AS tiny,
 CAST(coalesce(CASE WHEN l_linenumber <= 4 THEN l_tax END, 2809) AS DOUBLE) AS small_decimal,
 coalesce(CASE WHEN l_linenumber <= 4 THEN l_returnflag END, 'none') AS flag FROM lineitem""",
)
def null_policy_types(spark, sf):
    """Types too narrow for the fill are widened; the fills are the caller's."""
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "CASE WHEN l_linenumber <= 4 THEN CAST(l_linenumber AS TINYINT) END AS tiny",
        "CASE WHEN l_linenumber <= 4 THEN CAST(l_tax AS DECIMAL(3,2)) END AS small_decimal",
        "CASE WHEN l_linenumber <= 4 THEN l_returnflag END AS flag",
    )
    out = null_policy(df, fill_text="none", fill_number=2809)
    return out.withColumn("small_decimal", F.col("small_decimal").cast("double"))


@query("entropy_endless", "SELECT 'v' AS \"column\", CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS entropy FROM lineitem")
def entropy_endless(spark, sf):
    """A column with an infinite value has no equal bins and no score."""
    df = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_linenumber = 7 THEN double('Infinity') ELSE l_quantity END AS v")
    return entropy_numeric(df, ["v"]).select("column", "n", "entropy")


@query(
    "stream_row_functions",
    """SELECT event_id, epoch_us(ts) // 1000 AS ts_ms,
 CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'others' END AS "kinds-str",
 event_type = 'click' AS "kinds-click" FROM events""",
)
def stream_row_functions(spark, sf):
    """The row-wise functions on a stream of the events, written once it has caught up, and read back."""
    path = scratch_path(spark, "arrivals")  # a stream reads a folder, and a table may be a single file
    table(spark, sf, "events").write.parquet(path)
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    events = streaming.date_to_long(events, "ts", "ts_ms").withColumn("kinds", F.array("event_type"))
    out = streaming.array_first_term(streaming.array_indicators(events, "kinds", ["click"]), "kinds", ["click", "view"])
    target = scratch_path(spark, "stream")
    run = out.select("event_id", "ts_ms", "`kinds-str`", "`kinds-click`").writeStream.format("parquet")
    run.option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target)


@query(
    "entry_metadata",
    """SELECT 'o_orderstatus_quali' AS "column", 'string' AS type, CAST(NULL AS VARCHAR) AS format, CAST(2 AS BIGINT) AS "values",
 CAST(count(o_orderstatus) AS BIGINT) AS n FROM orders
 UNION ALL SELECT 'o_orderpriority_quali', 'own', NULL, NULL, CAST(count(o_orderpriority) AS BIGINT) FROM orders
 UNION ALL SELECT 'o_totalprice_quanti', 'double', NULL, NULL, CAST(count(o_totalprice) AS BIGINT) FROM orders
 UNION ALL SELECT 'o_orderdate_date', 'date', 'MM/dd/yyyy', NULL, CAST(count(o_orderdate) AS BIGINT) FROM orders""",
)
def entry_metadata(spark, sf):
    """Each cast column keeps its catalog entry, unless it had metadata of its own; with the values it holds."""
    o = table(spark, sf, "orders").select(
        "o_orderstatus",
        F.col("o_orderpriority").alias("o_orderpriority", metadata={"o_orderpriority": {"type": "own"}}),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"),
    )
    entries = {
        "o_orderstatus": {"type": "string", "values": ["F", "O"]},
        "o_orderpriority": {"type": "string"},
        "o_totalprice": {"type": "double"},
        "o_orderdate": {"type": "date", "format": "MM/dd/yyyy"},
    }
    out = cast_by_role(o, entries)
    rows = []
    for f in out.schema.fields:
        e = next(iter(f.metadata.values()))
        listed = F.lit(len(e["values"]) if e.get("values") else None).cast("bigint")
        known = [F.lit(f.name).alias("column"), F.lit(e["type"]).alias("type"), F.lit(e.get("format")).cast("string").alias("format")]
        rows.append(F.struct(*known, listed.alias("values"), F.col(f.name).alias("n")))
    return rows_of(out.agg(*[F.count(c).alias(c) for c in out.columns]), rows)


_ROLES = {
    "string": ["l_returnflag", "l_linestatus"],
    "numeric": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "timestamp": ["l_shipdate"],
    "date": ["day"],
    "array": ["flags"],
    "other": ["late"],
}


@query(
    "role_split",
    " UNION ALL ".join(
        f"""SELECT '{role}' AS role, '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n FROM
 (SELECT *, CAST(l_shipdate AS DATE) AS day, [l_returnflag] AS flags, l_linenumber > 4 AS late FROM lineitem)"""
        for role, columns in _ROLES.items()
        for c in columns
    ),
)
def role_split(spark, sf):
    """Columns by the kind their types make them, each with its number of values."""
    df = table(spark, sf, "lineitem").selectExpr("*", "CAST(l_shipdate AS DATE) AS day", "array(l_returnflag) AS flags", "l_linenumber > 4 AS late")
    rows = [(role, c) for role, columns in split_by_role(df).items() for c in columns]
    counts = df.agg(*[F.count(c).alias(c) for _, c in rows])
    return rows_of(counts, [F.struct(F.lit(role).alias("role"), F.lit(c).alias("column"), F.col(c).alias("n")) for role, c in rows])


@query(
    "stages_pipeline",
    """SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN left(o_orderpriority, 1) ELSE 'others' END AS "words-str",
 o_orderpriority LIKE '%-URGENT' AS "words-URGENT", epoch_us(o_orderdate) // 1000 AS ms, i AS "o_orderstatus-index",
 CAST(o_totalprice AS DOUBLE) AS o_totalprice_quanti, false AS mostly_null_kept
 FROM orders JOIN (SELECT o_orderstatus AS s, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS DOUBLE) AS i
 FROM orders GROUP BY 1) ON s = o_orderstatus""",
)
def stages_pipeline(spark, sf):
    """The operators as stages of one pipeline, fitted, and applied."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.split("o_orderpriority", "-").alias("words"), "o_orderdate",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 10 == 0, "q").alias("mostly_null"),
    )
    model = Pipeline(
        stages=[
            stages.NullPolicy(),
            stages.FirstTerm(inputCol="words", terms=["1", "2"]),
            stages.TermIndicators(inputCol="words", terms=["URGENT"]),
            stages.EpochMillis(inputCol="o_orderdate", outputCol="ms"),
            stages.NonNullIndexer(inputCols=["o_orderstatus"]),
            stages.RoleCaster(inputCols=["o_totalprice"], entries={"o_totalprice": {"type": "double"}}),
        ]
    ).fit(o)
    out = model.transform(o)
    return out.select(
        "o_orderkey", "`words-str`", "`words-URGENT`", "ms", "`o_orderstatus-index`", "o_totalprice_quanti",
        F.lit("mostly_null" in out.columns).alias("mostly_null_kept"),
    )
