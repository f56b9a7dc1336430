"""Row-wise type conversion by column role. Pure column expressions: they also work on streams."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import dtype, is_date, is_time, ref, require_new, require_present
from colscope.constants import NULL_TERM


def whitelist(c: Column, allowed: Iterable[str]) -> Column:
    """Keep an allowed value; anything else, null included, becomes the text ``null``."""
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(NULL_TERM))


def to_date(c: Column, fmt: str) -> Column:
    """Parse a text date; unparsable text gives null instead of failing the job."""
    return F.try_to_date(c, fmt)


def to_number(c: Column, type_name: str) -> Column:
    """Cast to any SQL type name; unparsable values give null instead of failing the job."""
    return c.try_cast(type_name)


def _as_time(c: Column, t: T.DataType) -> Column:
    """Instant of a timestamp. A zone-less value is read as UTC under any session time zone."""
    if isinstance(t, T.TimestampNTZType):
        return F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    if isinstance(t, T.DateType):
        return _as_time(c.cast("timestamp_ntz"), T.TimestampNTZType())
    if isinstance(t, T.TimestampType):
        return c
    raise ValueError(f"type {t.simpleString()} is not a date or timestamp")


def epoch_seconds(c: Column, t: T.DataType) -> Column:
    """Whole seconds since 1970 (rounded down)."""
    return F.unix_seconds(_as_time(c, t))


def epoch_millis(c: Column, t: T.DataType) -> Column:
    """Whole milliseconds since 1970 (rounded down); null stays null."""
    return F.unix_millis(_as_time(c, t))


def epoch_micros(c: Column, t: T.DataType) -> Column:
    return F.unix_micros(_as_time(c, t))


def date_to_long(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """Add the epoch milliseconds of a timestamp column."""
    require_present(df, [input_col])
    require_new(df, [output_col])
    t = dtype(df, input_col)
    if not is_time(t):
        raise ValueError(f"column {input_col} has type {t.simpleString()}, not timestamp")
    return df.select("*", epoch_millis(ref(input_col), t).alias(output_col))


def cast_by_role(
    df: DataFrame, entries: Mapping[str, Mapping], columns: list[str] | None = None
) -> DataFrame:
    """Cast text columns to the types their catalog entries name, in one projection.

    ``string`` and ``terms`` columns become ``<col>_quali`` (values outside the entry's list, if it has
    one, become the text ``null``), ``date`` columns ``<col>_date``, ``number`` columns (as doubles) and
    all other SQL types ``<col>_quanti``. Columns of type ``other`` or ``coordinates`` are left out. The
    input column is replaced; a column that is a date already needs no format. The entry is kept as metadata of the output unless the input already has some.
    ``entries`` maps a column to ``{"type": ..., "format": ..., "values": ...}``; see
    ``sources.catalog.entries``.
    """
    wanted = columns if columns is not None else df.columns
    require_present(df, wanted)
    out: list[Column] = []
    made: list[str] = []
    for f in df.schema.fields:
        if f.name not in wanted:
            out.append(ref(f.name))
            continue
        e = entries.get(f.name)
        if not e or not e.get("type"):
            raise ValueError(f"no catalog entry for column {f.name}")
        c, kind = ref(f.name), e["type"]
        if kind in ("other", "coordinates"):
            continue
        if kind in ("string", "terms"):
            allowed = e.get("values")
            new, suffix = (c if not allowed else whitelist(c, allowed)), "quali"
        elif kind == "date" and is_date(f.dataType):
            new, suffix = c.cast("date"), "date"
        elif kind == "date":
            if not e.get("format"):
                raise ValueError(f"no date format for column {f.name}")
            new, suffix = to_date(c, e["format"]), "date"
        else:
            new, suffix = to_number(c, "double" if kind == "number" else kind), "quanti"
        meta = f.metadata or {f.name: json.loads(json.dumps(dict(e), default=list))}
        made.append(f"{f.name}_{suffix}")
        out.append(new.alias(made[-1], metadata=meta))
    require_new(df, made)
    return df.select(*out)


def whitelist_by_join(df: DataFrame, column: str, allowed: DataFrame, output_col: str) -> DataFrame:
    """``whitelist`` for a list too long to write into the plan.

    ``allowed`` has one column. No broadcast is forced: the optimizer broadcasts it only when its
    measured size allows, and otherwise joins by shuffle, where adaptive execution splits a hot key.
    """
    require_present(df, [column])
    require_new(df, [output_col])
    keys = allowed.select(ref(allowed.columns[0]).alias("_allowed")).where("_allowed is not null")
    joined = df.join(keys.distinct(), ref(column) == F.col("_allowed"), "left")
    return joined.select(
        *[ref(c) for c in df.columns],
        F.coalesce(F.col("_allowed"), F.lit(NULL_TERM)).alias(output_col),
    )
