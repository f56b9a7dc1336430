"""Small helpers for naming columns and telling their kind from the schema (no jobs run here)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Column by exact top-level name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType))


def is_date(t: T.DataType) -> bool:
    return isinstance(t, T.DateType) or is_time(t)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_term_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and is_text(t.elementType)


def split_by_role(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind: ``string``, ``numeric``, ``timestamp``, ``date``, ``array``, ``other``.

    Boolean columns count as ``other``; ``timestamp_ntz`` counts as ``timestamp``.
    """
    roles: dict[str, list[str]] = {
        k: [] for k in ("string", "numeric", "timestamp", "date", "array", "other")
    }
    for f in df.schema.fields:
        t = f.dataType
        if is_text(t):
            role = "string"
        elif is_numeric(t):
            role = "numeric"
        elif is_time(t):
            role = "timestamp"
        elif isinstance(t, T.DateType):
            role = "date"
        elif is_term_array(t):
            role = "array"
        else:
            role = "other"
        roles[role].append(f.name)
    return roles


def require_new(df: DataFrame, names: list[str]) -> None:
    """Raise when an output column would overwrite an existing one."""
    clash = sorted(set(names) & set(df.columns))
    if clash:
        raise ValueError(f"output columns already exist: {', '.join(clash)}")


def require_present(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def present(c: Column, t: T.DataType) -> Column:
    """The value, with NaN turned into null (missing numbers may arrive either way)."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(t))
    return c


def counting_key(c: Column) -> Column:
    """A text to count by: itself, or the digest of the whole text when it is long.

    Equal texts have equal keys, and no short text looks like a digest (65 characters), so counts are
    those of the texts, while long texts are not carried through the shuffle.
    """
    return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


def rows_of(agg: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per struct."""
    return agg.select(F.inline(F.array(*structs)))


def long_form(df: DataFrame, cols: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """``column, value`` rows, nulls left out. Values keep their type when all columns share it."""
    require_present(df, cols)
    same = len({dtype(df, c).simpleString() for c in cols}) == 1
    # positional aliases: unpivot reads its inputs by plain name
    picked = [
        (ref(c) if same else ref(c).cast("string")).alias(f"c{i}") for i, c in enumerate(cols)
    ]
    flat = df.select(*picked).unpivot([], [f"c{i}" for i in range(len(cols))], "_pos", value)
    return flat.where(ref(value).isNotNull()).select(
        name_of("_pos", cols).alias(name), ref(value)
    )


def name_of(pos: str, cols: list[str]) -> Column:
    """Original column name for a positional alias ``c<i>``."""
    pairs = [F.lit(x) for i, c in enumerate(cols) for x in (f"c{i}", c)]
    return F.element_at(F.create_map(*pairs), ref(pos))
