"""Values looked up by category, whatever the number of categories and however rows are spread over them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories, the most frequent ones, whose values are broadcast.
HOT_CATEGORIES = 1_000
#: Spare keys for rows that a shuffle does not concern.
SPREAD = 4_096


def look_up(
    rows: DataFrame, keys: dict[str, Column], found: DataFrame, values: list[str], size: int, hot: int = HOT_CATEGORIES
) -> DataFrame:
    """``rows`` with the ``values`` of ``found`` for their keys, null where it has none.

    ``keys`` names the columns of ``found`` and says what of a row they must equal. The first is an index by frequency below
    ``size``: rows of ``found`` below ``hot`` are broadcast, a bounded number for each key. The others, among which no
    key is frequent, are joined by shuffle, in which rows already served are spread by a hash of themselves.
    """
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
    first = next(iter(keys))
    out = rows.select("*", *[k.alias(f"_key_{c}") for c, k in keys.items()])

    def joined(out: DataFrame, part: DataFrame, tag: str, more: list[Column], mark: Column) -> DataFrame:
        part = part.select(*[F.col(c).alias(f"_{tag}_{c}") for c in [*keys, *values]], mark.alias(f"_{tag}"))
        part = F.broadcast(part) if tag == "hot" else part
        same = [F.col(f"_key_{c}") == F.col(f"_{tag}_{c}") for c in keys]
        return out.join(part, reduce(and_, [*same, *more]), "left")

    out = joined(out, found.where(F.col(first) < hot), "hot", [], F.lit(0))
    picked = {c: F.col(f"_hot_{c}") for c in values}
    if size > hot:
        spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[f"_key_{c}" for c in keys]), F.lit(SPREAD)).cast("int") + 1
        out = out.withColumn("_slot", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(spread))
        out = joined(out, found.where(F.col(first) >= hot), "cold", [F.col("_slot") == F.col("_cold")], F.lit(0))
        picked = {c: F.coalesce(f"_hot_{c}", f"_cold_{c}") for c in values}
    return out.select(*kept, *[v.alias(c) for c, v in picked.items()])
