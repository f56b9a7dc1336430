"""Normalised Shannon entropy of every column: 0 = one value, 1 = evenly spread.

With class counts c summing to n over k classes the score is

    (log2 n - sum(c * log2 c) / n) / log2 k

so it needs only sums over the class counts: no second join to the total, and no value list.
Rows are first reduced to class counts (combined before the shuffle), and everything after that
works on at most one row per class. Numeric and date columns need their bounds first; these come
from a one-row scalar subquery, so each kind reads its columns twice and no other pass is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import (
    counting_key,
    dtype,
    is_date,
    is_numeric,
    is_text,
    present,
    ref,
    require_present,
)
from colscope.constants import ENTROPY_BINS
from colscope.functions.dates import spans
from colscope.functions.typing import epoch_seconds

_LEVELS = ("year", "month", "week", "day", "hour", "minute", "second")
_SUB_DAY = 0b1110000  # the bits of hour, minute and second


def normalised_entropy(n: Column, c_log_c: Column, classes: Column) -> Column:
    """The score from n, sum(c * log2 c) and k. Null for one class, 0 for no rows."""
    raw = F.log2(n) - F.try_divide(c_log_c, n.cast("double"))
    # rounding may leave a tiny negative or a hair above one
    score = F.least(F.greatest(F.try_divide(raw, F.log2(classes)), F.lit(0.0)), F.lit(1.0))
    return F.when(n == 0, F.lit(0.0)).when(classes > 1, score)


# Low bits of a class key that hold the position of its column.
_POSITION_BITS = 16


def _empty(df: DataFrame, columns: int, value: T.DataType) -> DataFrame:
    """One row without a class per column, so that a column without values is reported too."""
    return df.sparkSession.range(columns, numPartitions=1).select(
        F.col("id").cast("int").alias("pos"), F.lit(None).cast(value).alias("v"),
        F.lit(0).cast("bigint").alias("c"),
    )


def _text_counts(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``pos, v, c``: rows per text value of each column."""
    names = [str(i) for i in range(len(keys))]
    flat = df.select(*[k.alias(n) for k, n in zip(keys, names)]).unpivot([], names, "pos", "v")
    counts = flat.where("v is not null").groupBy("pos", "v").agg(F.count("*").alias("c"))
    return counts.withColumn("pos", F.col("pos").cast("int")).unionByName(
        _empty(df, len(keys), T.StringType())
    )


def _stacked(df: DataFrame, values: list[Column], **fitted: Column) -> DataFrame:
    """``pos, v`` and the fitted arrays: the present values of all columns under each other.

    What follows is written once for all columns, so the generated code stays small enough to be
    compiled however many columns there are.
    """
    if len(values) > 1 << _POSITION_BITS:
        raise ValueError(f"more than {1 << _POSITION_BITS} columns")
    arrays = [c.alias(n) for n, c in fitted.items()]
    rows = df.select(F.array(*values).alias("a"), *arrays)
    return rows.select(*fitted, F.posexplode("a").alias("pos", "v")).where("v is not null")


def _number_counts(stacked: DataFrame, columns: int, unit: str) -> DataFrame:
    """``pos, v, c``: rows per whole-number class ``unit`` of each column.

    Class and column position share one number, the cheapest grouping key there is.
    """
    flat = stacked.selectExpr(f"shiftleft(cast({unit} AS bigint), {_POSITION_BITS}) + pos AS key")
    counts = flat.where("key is not null").groupBy("key").agg(F.count("*").alias("c"))
    return counts.select(
        F.col("key").bitwiseAND((1 << _POSITION_BITS) - 1).cast("int").alias("pos"),
        F.shiftright("key", _POSITION_BITS).alias("v"),
        "c",
    ).unionByName(_empty(stacked, columns, T.LongType()))


def _sums(counts: DataFrame, *keys: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.log2("c")).alias("clogc"),
        F.count("v").alias("k"),
        *extra,
    )


def _result(sums: DataFrame, columns: list[str], kind: str, k: Column, score: Column) -> DataFrame:
    return sums.select(
        F.element_at(F.array(*map(F.lit, columns)), F.col("pos") + 1).alias("column"),
        F.lit(kind).alias("kind"),
        F.col("n").cast("bigint").alias("n"),
        k.cast("bigint").alias("classes"),
        score.alias("entropy"),
    )


def _bounds(df: DataFrame, values: list[Column]) -> DataFrame:
    """Smallest and largest of each value in one row: ``lo0, hi0, lo1, ...``."""
    return df.agg(
        *[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("lo", F.min), ("hi", F.max))]
    )


def entropy_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Entropy of the value frequencies; nulls left out, k = number of distinct values."""
    require_present(df, columns)
    keys = [counting_key(present(ref(c), dtype(df, c)).cast("string")) for c in columns]
    sums = _sums(_text_counts(df, keys), "pos")
    k = F.col("k")
    return _result(sums, columns, "categorical", k, normalised_entropy(F.col("n"), F.col("clogc"), k))


def entropy_numeric(df: DataFrame, columns: list[str], bins: int = ENTROPY_BINS) -> DataFrame:
    """Entropy over bins: ``bins`` equal ones when the range exceeds ``bins``, else unit-wide ones.

    Bins are closed on the left and the largest value belongs to the last one; empty bins count as
    classes. At most ``bins + 1`` classes per column leave the first aggregation.
    """
    require_present(df, columns)
    values = [present(ref(c), dtype(df, c)).cast("double") for c in columns]
    # per column: the lower bound, and the bin width when bins are equal (null for unit bins)
    lows = [F.col(f"lo{i}") for i in range(len(columns))]
    ranges = [F.col(f"hi{i}") - lo for i, lo in enumerate(lows)]
    # no equal bins exist for an infinite range: such a column has no score
    endless = [F.isnan(r) | (r == F.lit(float("inf"))) for r in ranges]
    widths = [
        F.when(e, F.lit(float("nan"))).when(r > bins, r / F.lit(float(bins))) for r, e in zip(ranges, endless)
    ]
    found = _bounds(df, values)
    stacked = _stacked(
        df, values, lo=found.select(F.array(*lows)).scalar(), width=found.select(F.array(*widths)).scalar()
    ).selectExpr("pos", "v - lo[pos] AS above", "width[pos] AS width")
    # equal bins are numbered below zero, which tells the two kinds apart after counting
    unit = (
        f"CASE WHEN width IS NULL THEN floor(above) WHEN isnan(width) THEN -{10 * bins}"
        f" ELSE least(floor(above / width), {bins - 1}) - {bins} END"
    )
    counts = _number_counts(stacked, len(columns), unit)
    sums = _sums(counts, "pos", extra=(F.min("v").alias("first"), F.max("v").alias("last")))
    # the largest value always fills the last unit bin, so that bin tells the number of classes
    none = F.lit(None).cast("bigint")
    k = F.when(F.col("first") < -bins, none).when(F.col("first") < 0, F.lit(bins)).otherwise(F.coalesce(F.col("last") + 1, F.lit(0)))
    return _result(sums, columns, "numeric", k, normalised_entropy(F.col("n"), F.col("clogc"), k))


def granularities(lo: Column, hi: Column, t: T.DataType, monday_rule: bool) -> Column:
    """Bit set of the granularities a span qualifies for (bit i stands for ``_LEVELS[i]``)."""
    s = spans(lo, hi, t)
    week = s["weeks"] >= 1
    if monday_rule:
        # fixed rule: weeks are skipped when the first date is a Monday
        week = week & (F.weekday(lo) != 0)
    coarse = [s["years"] >= 1, s["months"] >= 1, week, s["days"] >= 1]
    sec = s["seconds"]
    fine = [F.ceil(sec / 3600) > 1, F.ceil(sec / 60) > 1, sec > 1]

    def bits(tests: list[Column], start: int) -> Column:
        ones = [F.when(x, F.lit(1 << (start + i))).otherwise(F.lit(0)) for i, x in enumerate(tests)]
        return reduce(lambda a, b: a + b, ones)

    mask = bits(coarse, 0)
    few = F.bit_count(mask) <= 1
    return mask + F.when(few, bits(fine, len(coarse))).otherwise(F.lit(0))


def _wall_seconds(c: Column, t: T.DataType) -> Column:
    """Seconds of the calendar time shown in the session time zone."""
    if isinstance(t, T.TimestampType):
        c, t = c.cast("timestamp_ntz"), T.TimestampNTZType()
    return epoch_seconds(c, t)


def entropy_date_levels(df: DataFrame, columns: list[str], monday_rule: bool = True) -> DataFrame:
    """Score of each qualifying granularity: ``pos, granularity, n, k, entropy``.

    Rows are counted once, by day, or by second where the span qualifies for sub-day scores (it then
    lies within one calendar month). Coarser granularities are summed from those counts. A column
    without any qualifying granularity gives one row with a null granularity.
    """
    require_present(df, columns)
    types = [dtype(df, c) for c in columns]
    masks = [granularities(F.col(f"lo{i}"), F.col(f"hi{i}"), t, monday_rule) for i, t in enumerate(types)]
    fits = _bounds(df, [ref(c) for c in columns]).select(F.array(*masks)).scalar()
    # the time of day is worked out only where sub-day scores need it
    first_fine = _SUB_DAY & -_SUB_DAY
    named = df.select(*[ref(c).alias(f"v{i}") for i, c in enumerate(columns)], fits.alias("fits"))
    seconds = [
        F.when(F.get("fits", F.lit(i)) >= first_fine, _wall_seconds(F.col(f"v{i}"), t)).otherwise(
            F.unix_date(F.col(f"v{i}").cast("date")).cast("bigint") * 86400
        )
        for i, t in enumerate(types)
    ]
    stacked = _stacked(named, seconds, fits=F.col("fits")).selectExpr("pos", "v", "fits[pos] AS mask")
    # the bit set travels in the low bits of the key, so that counting needs no join to it
    unit = f"IF(mask >= {first_fine}, v, cast(floor(v / 86400) AS bigint))"
    counts = _number_counts(stacked, len(columns), f"shiftleft({unit}, {len(_LEVELS)}) + mask")
    # a class is a day, or a second where a sub-day score is asked for
    unit = F.shiftright("v", len(_LEVELS))
    mask = F.coalesce(F.col("v").bitwiseAND((1 << len(_LEVELS)) - 1), F.lit(0))
    scale = F.when(mask >= first_fine, F.lit(1)).otherwise(F.lit(86400))
    return score_levels(counts.select("pos", "c", mask.alias("mask"), (unit * scale).alias("seconds")))


def score_levels(counts: DataFrame) -> DataFrame:
    """``pos, granularity, n, k, entropy`` of class counts ``pos, mask, seconds, c``; ``seconds`` is where a class
    begins and ``mask`` the granularities of its column."""
    listed = ", ".join(f"IF(mask & {1 << i} > 0, '{name}', NULL)" for i, name in enumerate(_LEVELS))
    levels = counts.selectExpr(
        "pos", "c", "seconds",
        "date_from_unix_date(cast(floor(seconds / 86400) AS int)) AS day",
        f"explode_outer(array_compact(array({listed}))) AS granularity",
    )
    key = F.expr(
        """CASE granularity
             WHEN 'year' THEN year(day)
             WHEN 'month' THEN year(day) * 12 + month(day)
             WHEN 'week' THEN unix_date(trunc(day, 'week'))
             WHEN 'day' THEN unix_date(day)
             WHEN 'hour' THEN floor(seconds / 3600)
             WHEN 'minute' THEN floor(seconds / 60)
             ELSE seconds
           END"""
    )
    per_key = levels.groupBy("pos", "granularity", key.alias("v")).agg(F.sum("c").alias("c"))
    score = normalised_entropy(F.col("n"), F.col("clogc"), F.col("k"))
    return _sums(per_key, "pos", "granularity").select("pos", "granularity", "n", "k", score.alias("entropy"))


def entropy_date(df: DataFrame, columns: list[str], monday_rule: bool = True) -> DataFrame:
    """Smallest entropy over the granularities a column's span qualifies for; 1.0 when none does.

    Granularities with a single class are ignored. ``classes`` belongs to the granularity chosen.
    """
    return smallest_entropy(entropy_date_levels(df, columns, monday_rule), columns)


def smallest_entropy(levels: DataFrame, columns: list[str]) -> DataFrame:
    """The best of each column's granularities as ``column, kind, n, classes, entropy``."""
    scored = F.col("granularity").isNotNull() & F.col("entropy").isNotNull()
    best = levels.groupBy("pos").agg(
        F.max("n").alias("n"), F.min(F.when(scored, F.struct("entropy", "k"))).alias("best")
    )
    empty = F.col("n") == 0
    k = F.when(empty, F.lit(0)).otherwise(F.coalesce("best.k", F.lit(1)))
    score = F.when(empty, F.lit(0.0)).otherwise(F.coalesce("best.entropy", F.lit(1.0)))
    return _result(best, columns, "date", k, score)


def column_kind(t: T.DataType) -> str:
    """How a type is scored; other types have no entropy here."""
    if is_text(t) or isinstance(t, T.BooleanType):
        return "categorical"
    if is_numeric(t):
        return "numeric"
    if is_date(t):
        return "date"
    raise ValueError(f"type {t.simpleString()} has no entropy")


def entropy_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Entropy of every column as ``position, column, kind, n, classes, entropy``.

    The number of passes depends on the kinds present, not on the number of columns, and each pass
    reads only the columns of its kind.
    """
    cols = columns if columns is not None else df.columns
    require_present(df, cols)
    kinds = {c: column_kind(dtype(df, c)) for c in cols}
    scorers = {"categorical": entropy_categorical, "numeric": entropy_numeric, "date": entropy_date}
    parts = [
        fn(df, [c for c in cols if kinds[c] == kind])
        for kind, fn in scorers.items()
        if kind in kinds.values()
    ]
    if not parts:
        raise ValueError("no columns to profile")
    places = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.element_at(places, F.col("column")).alias("position"), "*")
