"""The column catalog: one row per data column, read from a JSON document or built from a table.

Layout: ``column, entry, type, format, min_value, max_value, avg, empty_lines, values_count,
avg_values_count, is_multi, values, bounding_box`` where ``entry`` is the JSON text the row was read from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import (
    counting_key,
    dtype,
    is_date,
    is_numeric,
    is_term_array,
    is_text,
    name_of,
    present,
    ref,
    require_present,
    rows_of,
)
from colscope.functions.typing import epoch_millis
from colscope.operators.aggregates import field_terms, terms_topk


def _at(path: str) -> Column:
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.get_json_object(F.col("entry"), "$" + steps)


def _values() -> Column:
    """Allowed values as term -> count; a plain list of terms gives null counts."""
    none = F.lit(None).cast("bigint")
    counted = F.from_json(_at("values"), "array<map<string,bigint>>")
    merged = F.map_from_entries(F.flatten(F.transform(counted, F.map_entries)))

    def listed(path: str) -> Column:
        terms = F.from_json(_at(path), "array<string>")
        return F.map_from_entries(F.transform(F.array_distinct(terms), lambda t: F.struct(t, none)))

    # Both readings parse any array, so the shape is told from the text of the first element.
    objects = _at("values").rlike(r"^\s*\[\s*\{")
    return F.coalesce(F.when(objects, merged).otherwise(listed("values")), listed("array"))


def _box() -> Column:
    """Corners of the places of a ``coordinates`` column, however the document names them."""
    sides = {"top": "topLeft.lat", "left": "topLeft.lon", "bottom": "bottomRight.lat", "right": "bottomRight.lon"}
    found = {
        k: F.coalesce(_at(f"metrics.boundingBox.{k}"), _at(f"metrics.boundingBox.{p}")).try_cast("double")
        for k, p in sides.items()
    }
    return F.when(_at("metrics.boundingBox").isNotNull(), F.struct(*[v.alias(k) for k, v in found.items()]))


def from_entries(raw: DataFrame) -> DataFrame:
    """Catalog layout from ``column, entry`` rows."""
    kind = _at("type")
    multi = F.when(kind == "terms", _at("typeSettings.separator").isNotNull())
    return raw.select(
        "column",
        "entry",
        kind.alias("type"),
        # a mask writes days and years in capitals
        F.coalesce(
            _at("format"), F.when(kind == "date", F.translate(_at("typeSettings.mask"), "DY", "dy"))
        ).alias("format"),
        _at("metrics.minValue").try_cast("double").alias("min_value"),
        _at("metrics.maxValue").try_cast("double").alias("max_value"),
        _at("metrics.avg").try_cast("double").alias("avg"),
        _at("metrics.emptyLines").try_cast("bigint").alias("empty_lines"),
        _at("metrics.valuesCount").try_cast("bigint").alias("values_count"),
        _at("metrics.avgValuesCount").try_cast("double").alias("avg_values_count"),
        multi.alias("is_multi"),
        _values().alias("values"),
        _box().alias("bounding_box"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Read the JSON document (one object, one member per column) into the catalog layout.

    The member names are data, so the document is read as a map and not as a schema.
    """
    doc = spark.read.text(path, wholetext=True)
    members = F.from_json(F.col("value"), "map<string,string>")
    return from_entries(doc.select(F.explode(members).alias("column", "entry")))


def col_info(catalog: DataFrame, column: str, path: str) -> DataFrame:
    """Value at a dotted path of a column's entry as ``column, path, value``; null when absent."""
    return catalog.where(F.col("column") == column).select(
        "column", F.lit(path).alias("path"), _at(path).alias("value")
    )


def col_type(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.where(F.col("column") == column).select("column", "type")


def is_multi(catalog: DataFrame, column: str) -> DataFrame:
    """True or false for ``terms`` columns, null for the others."""
    return catalog.where(F.col("column") == column).select("column", "is_multi")


def col_values(catalog: DataFrame, column: str) -> DataFrame:
    """Allowed values as ``column, term, count`` rows."""
    return catalog.where(F.col("column") == column).select(
        "column", F.explode("values").alias("term", "count")
    )


def col_bounds(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.where(F.col("column") == column).select("column", "min_value", "max_value")


def select_columns(catalog: DataFrame, prefix: str = "data-") -> DataFrame:
    """Entries with the name prefix, those of type ``other`` left out (an unknown type stays)."""
    return catalog.where(
        F.col("column").startswith(prefix) & ~F.col("type").eqNullSafe(F.lit("other"))
    )


def quali_columns(catalog: DataFrame) -> DataFrame:
    """Entries of type ``terms``, whatever their name."""
    return catalog.where(F.col("type") == "terms")


def clean_columns(df: DataFrame, catalog: DataFrame, prefix: str = "data-") -> DataFrame:
    """Keep the table columns that ``select_columns`` keeps, in table order."""
    keep = {r["column"] for r in select_columns(catalog, prefix).select("column").collect()}
    return df.select(*[ref(c) for c in df.columns if c in keep])


def entries(catalog: DataFrame) -> dict[str, dict]:
    """The catalog on the driver, for building plans: one small entry per table column."""
    rows = catalog.select(
        "column", "type", "format", "min_value", "max_value", "is_multi", F.map_keys("values").alias("v")
    ).collect()
    return {
        r["column"]: {
            "type": r["type"],
            "format": r["format"],
            "min": r["min_value"],
            "max": r["max_value"],
            "is_multi": r["is_multi"],
            "values": sorted(r["v"]) if r["v"] is not None else None,
        }
        for r in rows
    }


def _is_point(t: T.DataType) -> bool:
    if not isinstance(t, T.StructType):
        return False
    return {"lat", "lon"} <= {f.name for f in t.fields if is_numeric(f.dataType)}


def infer_role(t: T.DataType) -> str:
    """Catalog type of a column, from its SQL type."""
    if is_text(t) or is_term_array(t) or isinstance(t, T.BooleanType):
        return "terms"
    if is_numeric(t):
        return "number"
    if is_date(t):
        return "date"
    if _is_point(t):
        return "coordinates"
    return "other"


def build_catalog(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Catalog metrics computed from the table: one aggregate, and one count of the values of all
    columns (a second one for arrays).

    ``column, type, min_value, max_value, avg, empty_lines, values_count, avg_values_count,
    bounding_box``. Dates are measured in epoch milliseconds. ``values_count`` is the exact number of
    distinct values; ``approximate=True`` uses a sketch instead, which spares the shuffle of the
    distinct values of wide or nearly unique columns. Array columns count distinct elements.
    """
    cols = columns if columns is not None else df.columns
    require_present(df, cols)
    null_d = F.lit(None).cast("double")
    null_n = F.lit(None).cast("bigint")
    point = "struct<top:double,left:double,bottom:double,right:double>"
    aggs: list[Column] = []
    structs: list[Column] = []
    exact: list[str] = []
    for i, name in enumerate(cols):
        t = dtype(df, name)
        role = infer_role(t)
        c = present(ref(name), t)
        counted = role in ("terms", "number", "date") and not is_term_array(t)
        distinct = F.approx_count_distinct(c) if counted and approximate else null_n
        if counted and not approximate:
            exact.append(name)
        size = F.avg(F.when(c.isNotNull(), F.size(c))) if is_term_array(t) else null_d
        has = F.max(c.isNotNull().cast("double")) if role != "other" and not is_term_array(t) else size
        # a date's bounds are taken before converting, so the scan compares native values
        lo = F.min(c) if role in ("number", "date") else null_d
        hi = F.max(c) if role in ("number", "date") else null_d
        mean = F.avg(c.cast("double")) if role == "number" else null_d
        box = F.lit(None).cast(point)
        if role == "coordinates":
            lat, lon = c.getField("lat").cast("double"), c.getField("lon").cast("double")
            box = F.struct(
                F.max(lat).alias("top"), F.min(lon).alias("left"),
                F.min(lat).alias("bottom"), F.max(lon).alias("right"),
            )
        aggs += [
            lo.alias(f"lo{i}"), hi.alias(f"hi{i}"), mean.alias(f"avg{i}"),
            F.count_if(c.isNull()).alias(f"empty{i}"), distinct.alias(f"distinct{i}"),
            F.when(has > 0, has).alias(f"size{i}"), box.alias(f"box{i}"),
        ]

        def bound(n: str) -> Column:
            v = ref(f"{n}{i}")
            return (epoch_millis(v, t) if role == "date" else v).cast("double")

        structs.append(
            F.struct(
                F.lit(name).alias("column"), F.lit(role).alias("type"),
                bound("lo").alias("min_value"), bound("hi").alias("max_value"),
                ref(f"avg{i}").alias("avg"), ref(f"empty{i}").alias("empty_lines"),
                ref(f"distinct{i}").cast("bigint").alias("values_count"),
                ref(f"size{i}").alias("avg_values_count"),
                ref(f"box{i}").alias("bounding_box"),
            )
        )
    out = rows_of(df.agg(*aggs), structs)
    parts = [_distinct_values(df, exact)] if exact else []
    arrays = [c for c in cols if is_term_array(dtype(df, c))]
    if arrays:
        count = F.approx_count_distinct if approximate else F.count_distinct
        parts.append(field_terms(df, arrays).groupBy("field").agg(count("term").alias("_distinct")))
    if not parts:
        return out
    named = out.join(reduce(DataFrame.unionByName, parts), F.col("column") == F.col("field"), "left")
    # a column counted exactly that has no values at all has no row among the counts
    found = F.coalesce("values_count", "_distinct", F.when(F.col("type").isin("terms", "number", "date"), 0))
    return named.select(
        *[found.cast("bigint").alias(c) if c == "values_count" else F.col(c) for c in out.columns]
    )


def _typed_key(c: Column, t: T.DataType) -> Column:
    """A value of any countable type as ``struct<n, d, s>``, one field set; equal keys are equal values of a column."""
    n, d, s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(t, (T.BooleanType, T.IntegralType)):
        n = c.cast("bigint")
    elif isinstance(t, T.DateType):
        n = F.unix_date(c).cast("bigint")
    elif isinstance(t, T.TimestampType):
        n = F.unix_micros(c)
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
    elif is_text(t):
        s = counting_key(c.cast("string"))
    else:  # decimals of one scale, timestamps without a zone
        s = c.cast("string")
    return F.when(c.isNotNull(), F.struct(n.alias("n"), d.alias("d"), s.cast("string").alias("s")))


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, _distinct`` for columns of any types, in one scan.

    Values are grouped in long form, under a key common to all types: one narrow row per value instead of one wide row
    per value and column, which is what several distinct counts in one aggregate would shuffle.
    """
    keys = [_typed_key(present(ref(c), dtype(df, c)), dtype(df, c)) for c in columns]
    values = df.select(*[k.alias(f"c{i}") for i, k in enumerate(keys)])
    flat = values.unpivot([], values.columns, "pos", "v").where("v is not null").select("pos", "v.*")
    return (
        flat.groupBy("pos", "n", "d", "s").agg(F.lit(1).alias("one"))
        .groupBy("pos").agg(F.count("one").alias("_distinct"))
        .select(name_of("pos", columns).alias("field"), "_distinct")
    )


def catalog_document(df: DataFrame, columns: list[str] | None = None, terms: int = 30) -> DataFrame:
    """One row, one text column: the JSON document describing the table's columns.

    Built from ``build_catalog`` and the terms of each qualitative column, so writing it with
    ``df.write.text`` gives a file that ``read_catalog`` accepts. A column of at most ``terms`` different
    values lists them all as its allowed ``values``; of any other the leading ones are written as
    ``topValues``, which no reader takes for a list of what is allowed.
    """
    cols = columns if columns is not None else df.columns
    metrics = build_catalog(df, cols)
    quali = [c for c in cols if infer_role(dtype(df, c)) == "terms"]
    if quali:
        top = terms_topk(df, quali, terms).groupBy("field").agg(
            F.sort_array(F.collect_list(F.struct("rank", "term", "count"))).alias("top")
        )
        metrics = metrics.join(top, F.col("column") == F.col("field"), "left")
        listed = F.transform("top", lambda t: F.create_map(t["term"], t["count"]))
    else:
        listed = F.lit(None).cast("array<map<string,bigint>>")
    complete = F.col("values_count") <= F.lit(terms)
    entry = F.struct(
        F.col("type"),
        F.when(complete, listed).alias("values"),
        F.when(~complete, listed).alias("topValues"),
        F.struct(
            F.col("min_value").alias("minValue"), F.col("max_value").alias("maxValue"), F.col("avg"),
            F.col("empty_lines").alias("emptyLines"), F.col("values_count").alias("valuesCount"),
            F.col("avg_values_count").alias("avgValuesCount"),
            F.col("bounding_box").alias("boundingBox"),
        ).alias("metrics"),
    )
    # one entry per table column: a catalog is small whatever the size of the table
    return metrics.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("column", entry.alias("entry"))))).alias("value")
    )
