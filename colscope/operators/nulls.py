"""Null shares, the share-based null policy, and fills by role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import dtype, is_numeric, is_text, present, ref, require_present, rows_of
from colscope.constants import DROP_BELOW, FILL_BELOW, FILL_NUMBER, NULL_TERM


def null_profile(
    df: DataFrame,
    columns: list[str] | None = None,
    drop_below: float = DROP_BELOW,
    fill_below: float = FILL_BELOW,
) -> DataFrame:
    """Non-null share per column and what the policy does about it, in one aggregate.

    ``column, non_null, total, ratio, action``; action is ``drop`` (the column), ``fill``, ``keep``
    (in the fill band, but its type has no fill value), ``drop_rows``, or ``none`` for an empty table.
    NaN counts as present.
    """
    cols = columns if columns is not None else df.columns
    require_present(df, cols)
    aggs = [F.count(F.lit(1)).alias("total")]
    structs = []
    for i, name in enumerate(cols):
        aggs.append(F.count(ref(name)).alias(f"n{i}"))
        ratio = F.try_divide(F.col(f"n{i}").cast("double"), F.col("total").cast("double"))
        t = dtype(df, name)
        fillable = is_text(t) or is_numeric(t)
        action = (
            F.when(F.col("total") == 0, "none")
            .when(ratio < drop_below, "drop")
            .when(ratio < fill_below, "fill" if fillable else "keep")
            .otherwise("drop_rows")
        )
        structs.append(
            F.struct(
                F.lit(name).alias("column"), F.col(f"n{i}").alias("non_null"), F.col("total"),
                ratio.alias("ratio"), action.alias("action"),
            )
        )
    return rows_of(df.agg(*aggs), structs)


def filled_type(t: T.DataType, fill: float) -> T.DataType:
    """The column's type, widened where it cannot hold the fill."""
    if isinstance(t, T.DecimalType):
        digits = max(len(str(int(abs(fill)))), t.precision - t.scale)
        return T.DecimalType(min(digits + t.scale, 38), t.scale)
    if isinstance(t, T.IntegralType):
        if fill != int(fill):
            return T.DoubleType()
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
        return next(n() for n, b in bits.items() if b >= bits[type(t)] and -(2**b) <= fill < 2**b)
    return t


@dataclass(frozen=True)
class NullPlan:
    """What the null policy decided; applying it needs no further pass."""

    dropped: list[str] = field(default_factory=list)
    filled: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, fill_text: str = NULL_TERM, fill_number: float = FILL_NUMBER) -> DataFrame:
        """The table without nulls, as planned. A numeric column whose type is too narrow for
        ``fill_number`` comes out in the next type that holds it."""
        out = df.drop(*[c for c in self.dropped if c in df.columns])
        text = [c for c in self.filled if is_text(dtype(df, c))]
        number = [c for c in self.filled if is_numeric(dtype(df, c))]
        for c in text + number + self.required:
            require_present(df, [c])
        if self.required:
            whole = None
            for c in self.required:
                ok = present(ref(c), dtype(df, c)).isNotNull()
                whole = ok if whole is None else whole & ok
            out = out.where(whole)
        if not (text or number):
            return out
        fills = {c: F.lit(fill_text) for c in text}
        wide = {c: filled_type(dtype(df, c), fill_number) for c in number}
        fills |= {c: F.lit(fill_number).cast(wide[c]) for c in number}
        return out.select(
            *[
                F.coalesce(present(ref(f.name), f.dataType).cast(wide.get(f.name, f.dataType)), fills[f.name]).alias(f.name, metadata=f.metadata)
                if f.name in fills
                else ref(f.name)
                for f in out.schema.fields
            ]
        )


def fit_null_policy(
    df: DataFrame,
    columns: list[str] | None = None,
    drop_below: float = DROP_BELOW,
    fill_below: float = FILL_BELOW,
) -> NullPlan:
    """Decide per column from the shares on the given table (one row per column reaches the driver)."""
    rows = null_profile(df, columns, drop_below, fill_below).select("column", "action").collect()
    by = {a: [r["column"] for r in rows if r["action"] == a] for a in ("drop", "fill", "drop_rows")}
    return NullPlan(by["drop"], by["fill"], by["drop_rows"])


def null_policy(
    df: DataFrame, fill_text: str = NULL_TERM, fill_number: float = FILL_NUMBER, **options
) -> DataFrame:
    """Fit the policy and apply it to the same table."""
    return fit_null_policy(df, **options).apply(df, fill_text, fill_number)


def fill_by_role(df: DataFrame, quali: list[str], quanti: list[str]) -> DataFrame:
    """Qualitative columns become text with ``null`` for missing; quantitative ones double with NaN."""
    require_present(df, [*quali, *quanti])
    fills = {c: F.coalesce(ref(c).cast("string"), F.lit(NULL_TERM)) for c in quali}
    fills |= {c: F.coalesce(ref(c).cast("double"), F.lit(float("nan"))) for c in quanti}
    return df.select(
        *[
            fills[f.name].alias(f.name, metadata=f.metadata) if f.name in fills else ref(f.name)
            for f in df.schema.fields
        ]
    )
