"""Pair counts, value distances, significances and clusters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from colscope.operators import encode
from colscope.operators.aggregates import pair_counts
from colscope.operators.clusters import fit_mixed_clusters
from colscope.operators.mixed import conditional_proba, mixed_distance, nearest_values, requested_distance, row_distance, significance, value_distance
from colscope.registry import query, table

_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _line(spark, sf):
    return table(spark, sf, "lineitem").select(*_COLS)


_TEXT = "(SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)"


def _pairs_sql(cols: list[str], source: str) -> str:
    """Counts per value pair of each ordered pair of columns."""
    return "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS ci, '{b}' AS cj, "{a}" AS vi, "{b}" AS vj, count(*) AS n FROM {source}
 WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL GROUP BY 3, 4"""
        for a, b in permutations(cols, 2)
    )


def _proba_sql(cols: list[str], source: str) -> str:
    return f"""SELECT ci, vi, cj, vj, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY ci, cj, vi) AS p
 FROM ({_pairs_sql(cols, source)})"""


def _distance_sql(cols: list[str], source: str, proba: str | None = None) -> str:
    """The direct sum over all values w of the larger share, a missing pair counting as zero."""
    return f"""WITH p AS ({proba or _proba_sql(cols, source)}),
 v AS (SELECT DISTINCT ci, vi FROM p),
 g AS (SELECT x.ci, x.vi AS vx, y.vi AS vy, w.cj, w.vj FROM v x JOIN v y ON x.ci = y.ci AND x.vi < y.vi
 JOIN (SELECT DISTINCT ci, cj, vj FROM p) w ON w.ci = x.ci),
 m AS (SELECT g.ci, g.vx, g.vy, sum(greatest(coalesce(a.p, 0), coalesce(b.p, 0))) / {len(cols) - 1} AS coo
 FROM g LEFT JOIN p a ON a.ci = g.ci AND a.vi = g.vx AND a.cj = g.cj AND a.vj = g.vj
 LEFT JOIN p b ON b.ci = g.ci AND b.vi = g.vy AND b.cj = g.cj AND b.vj = g.vj GROUP BY 1, 2, 3)
 SELECT ci AS "column", vx, vy, round(coo, 6) AS cooccurrence, round(coo - 1, 6) AS distance FROM m"""


@query(
    "pair_counts",
    f"""SELECT ci, cj, vi, vj, CAST(n AS BIGINT) AS "count" FROM ({_pairs_sql(_COLS, _TEXT)})""",
)
def pair_counts_query(spark, sf):
    return pair_counts(_line(spark, sf), _COLS)


@query("conditional_proba", f"SELECT ci, vi, cj, vj, round(p, 6) AS p FROM ({_proba_sql(_COLS, _TEXT)})")
def conditional_proba_query(spark, sf):
    return conditional_proba(pair_counts(_line(spark, sf), _COLS)).withColumn("p", F.round("p", 6))


def _rounded_distance(df, nudge: float = 0.0):
    return df.withColumns({c: F.round(F.col(c) + nudge, 6) for c in ("cooccurrence", "distance")})


@query("value_distance", _distance_sql(_COLS, _TEXT))
def value_distance_query(spark, sf):
    proba = conditional_proba(pair_counts(_line(spark, sf), _COLS))
    return _rounded_distance(value_distance(proba, len(_COLS)))


_WIDE = ["p_brand", "p_type", "p_size"]
_WIDE_TEXT = "(SELECT p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part)"


@query(
    "value_distance_wide",
    f"""SELECT * FROM ({_distance_sql(_WIDE, _WIDE_TEXT)})
 WHERE "column" = 'p_brand' AND vx = (SELECT min(p_brand) FROM part)""",
)
def value_distance_wide(spark, sf):
    """Distances of the first brand to every other one, asked for as pairs."""
    part = table(spark, sf, "part").select(*_WIDE)
    brands = part.select(F.col("p_brand").alias("vy")).distinct()
    first = part.agg(F.min("p_brand").alias("vx"))
    pairs = brands.join(F.broadcast(first), F.col("vy") > F.col("vx")).select(F.lit("p_brand").alias("column"), "vx", "vy")
    return _rounded_distance(requested_distance(conditional_proba(pair_counts(part, _WIDE)), len(_WIDE), pairs))


_BUYERS = ["customer", "day", "price"]
_BUYER_TEXT = "(SELECT CAST(o_custkey AS VARCHAR) AS customer, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(floor(o_totalprice / 500) AS BIGINT) AS VARCHAR) AS price FROM orders)"


@query(
    "nearest_values",
    f"""WITH p AS ({_proba_sql(_BUYERS, _BUYER_TEXT)}),
 m AS (SELECT a.vi AS x, b.vi AS y, round(sum(least(a.p, b.p)), 9) AS low FROM p a JOIN p b
 ON a.ci = 'customer' AND b.ci = 'customer' AND a.cj = b.cj AND a.vj = b.vj AND a.vi <> b.vi GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY x ORDER BY low DESC, y) AS INTEGER) AS rank FROM m)
 SELECT 'customer' AS "column", x AS value, rank, y AS nearest, round(greatest(1 - low / 2, 0), 6) AS distance FROM r WHERE rank <= 5""",
)
def nearest_values_query(spark, sf):
    """The five customers that order most alike, by days and by prices."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.floor(F.col("o_totalprice") / 500).cast("string").alias("price")
    )
    proba = conditional_proba(pair_counts(o, _BUYERS)).where(F.col("ci") == "customer")
    return nearest_values(proba, len(_BUYERS), 5).withColumn("distance", F.round("distance", 6))


_TERMS = ["terms", "p_brand", "p_type"]
# a row counts once in all: its distinct terms share it
_SHARED = """SELECT ci, vi, cj, vj, n / sum(n) OVER (PARTITION BY ci, cj, vi) AS p FROM (
 SELECT a.c AS ci, a.v AS vi, b.c AS cj, b.v AS vj, sum(a.w * b.w) AS n FROM s a JOIN s b ON a.id = b.id AND a.c <> b.c GROUP BY ALL)"""
_SHARES = """s AS (
 SELECT p_partkey AS id, 'terms' AS c, unnest(terms) AS v, CAST(1 AS DOUBLE) / len(terms) AS w
 FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ') || [p_type]) AS terms FROM part)
 UNION ALL SELECT p_partkey, 'p_brand', p_brand, 1 FROM part
 UNION ALL SELECT p_partkey, 'p_type', p_type, 1 FROM part)"""


def _parts(spark, sf):
    terms = F.concat(F.split("p_name", " "), F.array("p_type"))
    return table(spark, sf, "part").select("p_partkey", terms.alias("terms"), "p_brand", "p_type")


# sums of shares differ in their last digits with the order of rows, which must not decide how halves are rounded
_NUDGE = 1e-9


@query(
    "multi_valued_distance",
    f"WITH {_SHARES} SELECT * FROM ({_distance_sql(_TERMS, '', _SHARED)})".replace("(coo, 6)", f"(coo + {_NUDGE}, 6)").replace("(coo - 1, 6)", f"(coo - 1 + {_NUDGE}, 6)"),
)
def multi_valued_distance(spark, sf):
    """Distances of the words of part names and their types, a column of several values a row, of brands and of types."""
    return _rounded_distance(value_distance(conditional_proba(pair_counts(_parts(spark, sf), _TERMS)), len(_TERMS)), _NUDGE)


@query(
    "multi_valued_rows",
    f"""WITH {_SHARES}, d AS (SELECT vx, vy, distance FROM ({_distance_sql(_TERMS, '', _SHARED).replace("round(coo - 1, 6)", "coo - 1")}) WHERE "column" = 'terms')
 SELECT x.id AS x, y.id AS y, round(sum(x.w * y.w * CASE WHEN x.v = y.v THEN 0 ELSE d.distance END) + {_NUDGE}, 6) AS distance
 FROM s x JOIN s y ON y.id = x.id + 1 AND x.c = 'terms' AND y.c = 'terms'
 LEFT JOIN d ON d.vx = least(x.v, y.v) AND d.vy = greatest(x.v, y.v) GROUP BY x.id, y.id""",
)
def multi_valued_rows(spark, sf):
    """How far each part's words are from the next part's."""
    parts = _parts(spark, sf)
    ids = parts.select(F.col("p_partkey").alias("x"))
    pairs = ids.withColumn("y", F.col("x") + 1).join(ids.select(F.col("x").alias("y")), ["y"], "left_semi")
    found = value_distance(conditional_proba(pair_counts(parts, _TERMS)), len(_TERMS))
    return row_distance(parts, "p_partkey", "terms", pairs, found).withColumn("distance", F.round(F.col("distance") + _NUDGE, 6))


def _bin_sql(c: str) -> str:
    lo, hi = f"(SELECT min({c}) FROM lineitem)", f"(SELECT max({c}) FROM lineitem)"
    edges = [f"CASE WHEN {c} >= {lo} + (({hi} - {lo}) / 10) * {i} THEN 1 ELSE 0 END" for i in range(1, 10)]
    return f"CAST({' + '.join(edges)} AS DOUBLE)"


def _code_sql(c: str) -> str:
    return f"""(SELECT {c} AS label, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS i
 FROM lineitem GROUP BY {c})"""


_INDEX = ["l_returnflag-index", "l_linestatus-index"]
_BINS = ["l_quantity-bucketized", "l_extendedprice-bucketized"]
_ENCODED = f"""(SELECT a.i AS "l_returnflag-index", b.i AS "l_linestatus-index",
 {_bin_sql("l_quantity")} AS "l_quantity-bucketized", {_bin_sql("l_extendedprice")} AS "l_extendedprice-bucketized"
 FROM lineitem JOIN {_code_sql("l_returnflag")} a ON l_returnflag = a.label
 JOIN {_code_sql("l_linestatus")} b ON l_linestatus = b.label)"""


def _encoded(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return encode.bucketize(
        encode.string_index(df, ["l_returnflag", "l_linestatus"]), ["l_quantity", "l_extendedprice"]
    )


def _significance_sql(cols: list[str], source: str, wanted: list[str]) -> str:
    names = ", ".join(f"'{c}'" for c in wanted)
    return f"""SELECT "column", round(sum(distance) / 45, 6) AS significance,
 round(sum(cooccurrence) / 45, 6) AS significance_raw FROM ({_distance_sql(cols, source)})
 WHERE "column" IN ({names}) GROUP BY "column" """


@query("significance", _significance_sql([*_INDEX, *_BINS], _ENCODED, _BINS).replace("round(coo, 6)", "coo").replace("round(coo - 1, 6)", "coo - 1"))
def significance_query(spark, sf):
    df = _encoded(spark, sf)
    cols = [*_INDEX, *_BINS]
    proba = conditional_proba(pair_counts(df, cols)).where(F.col("ci").isin(_BINS))
    return significance(proba, len(cols)).withColumns(
        {c: F.round(c, 6) for c in ("significance", "significance_raw")}
    )


@query(
    "mixed_distance",
    f"""SELECT * FROM ({_distance_sql([*_INDEX, *_BINS], _ENCODED)}) WHERE "column" LIKE '%-index'""",
)
def mixed_distance_query(spark, sf):
    return _rounded_distance(mixed_distance(_encoded(spark, sf), _INDEX, _BINS, store=False).cooccurrences)


@query("mixed_significance", _significance_sql([*_INDEX, *_BINS], _ENCODED, _BINS).replace("round(coo, 6)", "coo").replace("round(coo - 1, 6)", "coo - 1"))
def mixed_significance(spark, sf):
    """Significances as the whole analysis gives them, beside its distances."""
    found = mixed_distance(_encoded(spark, sf), _INDEX, _BINS, store=False).significances
    return found.withColumns({c: F.round(c, 6) for c in ("significance", "significance_raw")})


@query(
    "mixed_kmeans",
    """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS assigned,
 CAST(0 AS BIGINT) AS misplaced FROM lineitem GROUP BY ALL""",
)
def mixed_kmeans(spark, sf):
    """Every row is in one of the clusters, and no other cluster's centre is nearer to it; the distances to
    the centres are worked out a second time here, from the fitted means and shares."""
    df = _encoded(spark, sf)
    quanti = ["l_quantity", "l_extendedprice"]
    model = fit_mixed_clusters(df, _INDEX, quanti)
    rows = model.assign(df)
    every = []
    for c in model.centres:
        parts = []
        for name, w, m in zip(quanti, model.weights, c.means):
            lo, hi = model.bounds[name]
            parts.append(F.pow(F.lit(w) * ((F.col(name) - lo) / (hi - lo) - F.lit(m)), 2))
        for name, distances, shares in zip(_INDEX, model.tables, c.shares):
            cost = F.lit(0.0)
            for i, row in enumerate(distances):
                cost = F.when(F.col(f"`{name}`") == i, F.lit(sum(s * d for s, d in zip(shares, row)) ** 2)).otherwise(cost)
            parts.append(cost)
        every.append(sum(parts[1:], parts[0]))
    off = F.abs(F.least(*every) - F.col("cluster_distance")) > 1e-9
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("cluster").between(0, len(model.centres) - 1)).alias("assigned"),
        F.count_if(off).alias("misplaced"),
    )


_GAP_TEXT = """(SELECT "l_returnflag-index", "l_linestatus-index", "l_extendedprice-bucketized",
 CASE WHEN "line" <> 7 THEN "l_quantity-bucketized" END AS "l_quantity-bucketized" FROM
 (SELECT a.i AS "l_returnflag-index", b.i AS "l_linestatus-index", l_linenumber AS "line",
 {q} AS "l_quantity-bucketized", {p} AS "l_extendedprice-bucketized"
 FROM lineitem JOIN {a} a ON l_returnflag = a.label JOIN {b} b ON l_linestatus = b.label))""".format(
    q=_bin_sql("l_quantity").replace("(SELECT min(l_quantity) FROM lineitem)", "(SELECT min(l_quantity) FROM lineitem WHERE l_linenumber <> 7)").replace("(SELECT max(l_quantity) FROM lineitem)", "(SELECT max(l_quantity) FROM lineitem WHERE l_linenumber <> 7)"),
    p=_bin_sql("l_extendedprice"), a=_code_sql("l_returnflag"), b=_code_sql("l_linestatus"),
)


@query("bucketize_gaps", f"""SELECT "l_quantity-bucketized" AS bin, CAST(count(*) AS BIGINT) AS n FROM {_GAP_TEXT} GROUP BY 1""")
def bucketize_gaps(spark, sf):
    """A missing number has no bin, whether it is NaN or null."""
    df = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber <> 7 THEN l_quantity WHEN l_orderkey % 2 = 0 THEN double('NaN') END AS l_quantity"
    )
    return encode.bucketize(df, ["l_quantity"]).groupBy(F.col("`l_quantity-bucketized`").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
