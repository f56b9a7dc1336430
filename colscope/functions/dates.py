"""Spans between two dates, and the granularity a date column is bucketed at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import dtype, is_date, ref, require_new, require_present
from colscope.constants import MAX_CATEGORIES
from colscope.functions.typing import epoch_micros

_DAY = 86_400_000_000


def _ordered(a: Column, b: Column, value: Column) -> Column:
    """The value, or null when the first date is the later one (or either is null)."""
    return F.when(a <= b, value)


def years_between(a: Column, b: Column) -> Column:
    """Difference of the calendar years."""
    return _ordered(a, b, (F.year(b) - F.year(a)).cast("bigint"))


def months_between(a: Column, b: Column) -> Column:
    """Difference in calendar months (the day of month plays no part)."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return _ordered(a, b, months.cast("bigint"))


def _whole(elapsed: Column, unit: int) -> tuple[Column, Column]:
    """Whole units in a count of microseconds, and whether some are left; exact beyond 2**53 too."""
    rest = F.pmod(elapsed, F.lit(unit).cast("bigint"))
    return F.round((elapsed - rest) / F.lit(unit)).cast("bigint"), rest > 0


def days_between(a: Column, b: Column, t: T.DataType) -> Column:
    """Elapsed days, a started day counted as a whole one."""
    elapsed = epoch_micros(b, t) - epoch_micros(a, t)
    days, more = _whole(elapsed, _DAY)
    return _ordered(a, b, days + more.cast("bigint"))


def weeks_between(a: Column, b: Column, t: T.DataType) -> Column:
    """Elapsed days over seven, rounded up."""
    return F.ceil(days_between(a, b, t) / F.lit(7)).cast("bigint")


def seconds_between(a: Column, b: Column, t: T.DataType) -> Column:
    """Whole elapsed seconds."""
    elapsed = epoch_micros(b, t) - epoch_micros(a, t)
    return _ordered(a, b, _whole(elapsed, 1_000_000)[0])


def spans(a: Column, b: Column, t: T.DataType) -> dict[str, Column]:
    """All five spans; ``t`` is the common type of both columns."""
    return {
        "years": years_between(a, b),
        "months": months_between(a, b),
        "weeks": weeks_between(a, b, t),
        "days": days_between(a, b, t),
        "seconds": seconds_between(a, b, t),
    }


def date_span(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add the spans from column ``a`` to column ``b`` as ``years, months, weeks, days, seconds``."""
    require_present(df, [a, b])
    t = dtype(df, a)
    if t != dtype(df, b) or not is_date(t):
        raise ValueError(f"{a} and {b} must be dates or timestamps of one type")
    cols = spans(ref(a), ref(b), t)
    require_new(df, list(cols))
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


@dataclass(frozen=True)
class DateBucket:
    """How one date column is bucketed; learned from its span."""

    column: str
    granularity: str
    min_year: int | None = None
    width: int | None = None

    @property
    def output(self) -> str:
        role = "quali" if self.granularity in ("year_bin", "month") else "quanti"
        unit = "year" if self.granularity == "year_bin" else self.granularity
        return f"{self.column}_{unit}_{role}"

    def expr(self) -> Column:
        c = ref(self.column)
        if self.granularity == "year_bin":
            v = F.floor((F.year(c) - self.min_year) / self.width).cast("bigint")
        elif self.granularity == "month":
            v = F.concat(F.year(c).cast("string"), F.lit("-"), F.month(c).cast("string"))
        else:
            fn = {"year": F.year, "week": F.weekofyear, "day": F.dayofyear}[self.granularity]
            v = fn(c).cast("bigint")
        return v.alias(self.output, metadata={"origin": self.column})


def fit_date_buckets(df: DataFrame, columns: list[str]) -> list[DateBucket]:
    """Choose a granularity per date column from its span; one aggregate for all columns.

    More than 30 years: equal bins of years. More than 2 years: the year. More than 2 months: the
    month. At least 4 weeks: the ISO week. Otherwise the day of the year.
    """
    require_present(df, columns)
    if not columns:
        return []
    for c in columns:
        if not is_date(dtype(df, c)):
            raise ValueError(f"column {c} is not a date or timestamp")
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(ref(c)).alias(f"a{i}"), F.max(ref(c)).alias(f"b{i}")]
    picked = []
    for i, c in enumerate(columns):
        a, b, t = ref(f"a{i}"), ref(f"b{i}"), dtype(df, c)
        s = spans(a, b, t)
        picked += [
            F.year(a).alias(f"y{i}"),
            s["years"].alias(f"years{i}"),
            s["months"].alias(f"months{i}"),
            s["weeks"].alias(f"weeks{i}"),
        ]
    row = df.agg(*aggs).select(*picked).first()  # one row: four numbers per date column
    out = []
    for i, c in enumerate(columns):
        years, months, weeks = row[f"years{i}"] or 0, row[f"months{i}"] or 0, row[f"weeks{i}"] or 0
        if years > MAX_CATEGORIES:
            out.append(DateBucket(c, "year_bin", row[f"y{i}"], -(-years // MAX_CATEGORIES)))
        elif years > 2:
            out.append(DateBucket(c, "year"))
        elif months > 2:
            out.append(DateBucket(c, "month"))
        elif weeks >= 4:
            out.append(DateBucket(c, "week"))
        else:
            out.append(DateBucket(c, "day"))
    return out


def apply_date_buckets(df: DataFrame, buckets: list[DateBucket]) -> DataFrame:
    require_new(df, [b.output for b in buckets])
    return df.select("*", *[b.expr() for b in buckets])


def date_bucketize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add one bucket column per date column; the dates stay, and a null date gives a null bucket."""
    return apply_date_buckets(df, fit_date_buckets(df, columns))
