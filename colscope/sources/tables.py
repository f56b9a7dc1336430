"""Reading tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import ref, require_present


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """CSV with a header; every column stays text (no inference pass over the data)."""
    return spark.read.options(header=True, **options).csv(path)


def wrap_arrays(df: DataFrame, array_cols: Iterable[str]) -> DataFrame:
    """Turn the named columns into ``array<string>``; null stays null, arrays keep their elements."""
    wanted = set(array_cols)
    require_present(df, sorted(wanted))
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        if f.name not in wanted:
            out.append(c)
        elif isinstance(f.dataType, T.ArrayType):
            out.append(c.cast("array<string>").alias(f.name, metadata=f.metadata))
        else:
            one = F.when(c.isNotNull(), F.array(c.cast("string")))
            out.append(one.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def read_table(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    options: Mapping[str, str] | None = None,
    array_cols: Iterable[str] = (),
) -> DataFrame:
    """Any installed format. Document stores do not tell one value from a list of one, so fields
    that may hold several values are named in ``array_cols`` and always arrive as arrays."""
    reader = spark.read.format(fmt).options(**dict(options or {}))
    df = reader.load(path) if path is not None else reader.load()
    array_cols = list(array_cols)
    return wrap_arrays(df, array_cols) if array_cols else df
