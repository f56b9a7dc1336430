"""Flattening of multi-valued (array of text) columns. Pure column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.columns import dtype, is_term_array, ref, require_new, require_present
from colscope.constants import OTHER_TERM


def _check(df: DataFrame, column: str) -> None:
    require_present(df, [column])
    t = dtype(df, column)
    if not is_term_array(t):
        raise ValueError(f"column {column} has type {t.simpleString()}, not array<string>")


def first_term(c: Column, allowed: Iterable[str]) -> Column:
    """First element when it is allowed, else ``others`` (also for an empty or null array)."""
    head = F.get(c, F.lit(0))
    return F.when(head.isin(list(allowed)), head).otherwise(F.lit(OTHER_TERM))


def has_term(c: Column, term: str) -> Column:
    """Whether the array holds the term; false for a null array."""
    return F.coalesce(F.array_contains(c, term), F.lit(False))


def array_first_term(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Add ``<column>-str`` with the first allowed term."""
    _check(df, column)
    out = f"{column}-str"
    require_new(df, [out])
    return df.select("*", first_term(ref(column), allowed).alias(out, metadata={"origin": column}))


def indicator_names(column: str, terms: Iterable[str]) -> list[str]:
    return [f"{column}-{t}" for t in terms]


def array_indicators(df: DataFrame, column: str, terms: Iterable[str]) -> DataFrame:
    """Add one boolean ``<column>-<term>`` per term, in one projection."""
    _check(df, column)
    terms = list(terms)
    names = indicator_names(column, terms)
    if len(set(names)) != len(names):
        raise ValueError(f"repeated terms for column {column}")
    require_new(df, names)
    flags = [
        has_term(ref(column), t).alias(n, metadata={"origin": column}) for t, n in zip(terms, names)
    ]
    return df.select("*", *flags)
