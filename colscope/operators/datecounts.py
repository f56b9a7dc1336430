"""Date columns from counts of their days, which grow with the calendar and not with the rows.

A count frame has a row per column and day. Frames of parts of a table, or of new rows, merge to the frame
of all rows, and everything the library learns from dates follows from it: bounds, buckets and entropy. So a
partition that arrives is read once, and none of the older ones again.

Only dates are counted: a time of day would be lost in its day. Null dates are not counted. A column without any date
has no rows in a frame, and is named to what reads the frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import dtype, ref, require_present
from colscope.functions.dates import DateBucket, fit_date_buckets
from colscope.operators.entropy import granularities, score_levels, smallest_entropy

SCHEMA = "column string, day date, n bigint"


def date_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, day, n``: rows per date of each column, in one pass that combines before its shuffle."""
    require_present(df, columns)
    for c in columns:
        if not isinstance(dtype(df, c), T.DateType):
            raise ValueError(f"column {c} is not a date")
    named = [F.struct(F.lit(c).alias("column"), ref(c).alias("day")) for c in columns]
    if not named:
        return df.sparkSession.createDataFrame([], SCHEMA)
    days = df.select(F.inline(F.array(*named))).where("day is not null")
    return days.groupBy("column", "day").agg(F.count("*").alias("n"))


def merge_date_counts(*frames: DataFrame) -> DataFrame:
    """The frame of all rows that any of ``frames`` has counted; no row may have been counted twice."""
    if not frames:
        raise ValueError("no counts to merge")
    both = reduce(DataFrame.unionByName, frames)
    return both.groupBy("column", "day").agg(F.sum("n").alias("n"))


def date_bounds(counts: DataFrame) -> DataFrame:
    """``column, first, last, n``."""
    return counts.groupBy("column").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sum("n").alias("n"))


def buckets_of_counts(counts: DataFrame, columns: list[str]) -> list[DateBucket]:
    """The buckets that ``fit_date_buckets`` finds in the rows counted."""
    return fit_date_buckets(counts.select(*[_day_of(c).alias(c) for c in columns]), columns)


def _day_of(column: str) -> Column:
    return F.when(F.col("column") == column, F.col("day"))


def entropy_of_counts(counts: DataFrame, columns: list[str], monday_rule: bool = True) -> DataFrame:
    """What ``entropy_date`` gives for the rows counted: ``column, kind, n, classes, entropy``."""
    if not columns:
        raise ValueError("no columns to score")
    places = counts.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, column string")
    bounds = date_bounds(counts).drop("n")
    fits = places.join(F.broadcast(bounds), "column", "left")  # a row per column
    mask = F.coalesce(granularities(F.col("first"), F.col("last"), T.DateType(), monday_rule), F.lit(0))
    fits = fits.select("pos", "column", mask.alias("mask"))
    days = F.broadcast(fits).join(counts, "column", "left")
    unit = F.unix_date("day").cast("bigint") * 86400
    rows = days.select("pos", "mask", unit.alias("seconds"), F.coalesce("n", F.lit(0)).cast("bigint").alias("c"))
    return smallest_entropy(score_levels(rows), columns)
