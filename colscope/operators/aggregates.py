"""Counts and statistics in long form: one row per (field, term), (field) or (column pair, values)."""

from __future__ import annotations

import json
from itertools import combinations
from math import isqrt, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.columns import (
    dtype,
    is_numeric,
    is_term_array,
    long_form,
    present,
    ref,
    require_present,
    rows_of,
)
from colscope.constants import TOP_TERMS

# Column combinations that may be pre-counted as whole tuples before being split into pairs.
TUPLE_LIMIT = 1_000_000

# Up to this k the optimizer turns row_number() <= k into a limit before the exchange
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000


def field_terms(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, term`` rows, nulls left out; an array gives each distinct term once per row."""
    require_present(df, fields)
    arrays = [c for c in fields if is_term_array(dtype(df, c))]
    scalars = [c for c in fields if c not in arrays]
    parts = []
    if scalars:
        parts.append(
            long_form(df, scalars, "field", "term").select("field", F.col("term").cast("string").alias("term"))
        )
    if arrays:
        empty = F.array().cast("array<struct<field:string,term:string>>")

        def tagged(c: str) -> Column:
            rows = F.transform(
                F.array_distinct(ref(c)), lambda t: F.struct(F.lit(c).alias("field"), t.alias("term"))
            )
            return F.coalesce(rows, empty)

        parts.append(df.select(F.inline(F.concat(*map(tagged, arrays)))).where("term is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(counts: DataFrame, size: int) -> DataFrame:
    # row_number() <= k becomes a group limit before the exchange, so a field with billions of
    # terms sends only k rows per input partition to the task that ranks it
    order = (F.desc("count"), F.asc("term"))
    if size > GROUP_LIMIT:
        # beyond what the optimizer limits by itself, limit slices of a field first
        slice_ = F.pmod(F.xxhash64("term"), F.lit(256))
        local = Window.partitionBy("field", slice_).orderBy(*order)
        counts = counts.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= size)
        counts = counts.drop("rank")
    w = Window.partitionBy("field").orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def terms_topk(df: DataFrame, fields: list[str], size: int = TOP_TERMS) -> DataFrame:
    """Most frequent terms per field with the number of rows holding them: ``field, term, count, rank``.

    Ordered by count, then term. Counts are exact.
    """
    counts = field_terms(df, fields).groupBy("field", "term").agg(F.count("*").alias("count"))
    return _ranked(counts, size)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every value of every column with its row count: ``column, value, count``."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("count"))


def stats_agg(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, count, min, max, avg, sum`` of numeric fields, in one aggregate."""
    require_present(df, fields)
    aggs: list[Column] = []
    structs: list[Column] = []
    for i, name in enumerate(fields):
        t = dtype(df, name)
        if not is_numeric(t):
            raise ValueError(f"column {name} is not numeric")
        c = present(ref(name), t).cast("double")
        for fn in ("count", "min", "max", "avg", "sum"):
            aggs.append(getattr(F, fn)(c).alias(f"{fn}{i}"))
        structs.append(
            F.struct(
                F.lit(name).alias("field"),
                *[ref(f"{fn}{i}").alias(fn) for fn in ("count", "min", "max", "avg", "sum")],
            )
        )
    return rows_of(df.agg(*aggs), structs)


def combined_agg(
    df: DataFrame, quali: list[str], quanti: list[str], size: int = TOP_TERMS
) -> DataFrame:
    """Both aggregations as JSON text: ``field, kind, body_json`` with kind ``terms`` or ``stats``."""
    parts = []
    if quali:
        # at most `size` rows per field reach this list
        buckets = F.sort_array(F.collect_list(F.struct("rank", "term", "count")))
        body = F.transform(buckets, lambda b: F.struct(b["term"].alias("key"), b["count"].alias("doc_count")))
        parts.append(
            terms_topk(df, quali, size)
            .groupBy("field")
            .agg(F.to_json(F.struct(body.alias("buckets"))).alias("body_json"))
            .select("field", F.lit("terms").alias("kind"), "body_json")
        )
    if quanti:
        body = F.to_json(F.struct("count", "min", "max", "avg", "sum"))
        parts.append(
            stats_agg(df, quanti).select("field", F.lit("stats").alias("kind"), body.alias("body_json"))
        )
    if not parts:
        raise ValueError("name at least one field")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def known_arity(df: DataFrame, column: str) -> int | None:
    """Number of categories an encoded column can hold, from its metadata; null when unknown."""
    attr = df.schema[column].metadata.get("ml_attr", {})
    if attr.get("type") != "nominal":
        return None
    return len(attr["vals"]) if "vals" in attr else attr.get("num_vals")


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value pair of every ordered column pair: ``ci, cj, vi, vj, count``.

    Each unordered pair is counted once and mirrored after counting. When the columns are known to
    have few value combinations, whole tuples are counted first, so each input row is hashed once and
    only the small table of tuples is split into pairs. Wider tables are cut into blocks of columns
    that have few combinations each, and the tuples of every two blocks are counted first: a row is
    expanded once for two blocks, not once for two columns. Columns of unknown arity are blocks of their
    own. All is combined before the shuffle. Rows null in either column of a pair are left out of that pair.

    A column may be an array of terms. A row then counts towards each of its distinct terms with an equal share, so
    that it counts once in all; ``count`` is a double then, and a row without terms is left out like one with a null.
    """
    require_present(df, columns)
    if len(columns) < 2:
        raise ValueError("pair counts need at least two columns")
    if len(set(columns)) != len(columns):
        raise ValueError("columns must be distinct")
    if any(is_term_array(dtype(df, c)) for c in columns):
        return _shared_pair_counts(df, columns)
    same = len({dtype(df, c).simpleString() for c in columns}) == 1
    arities = [known_arity(df, c) for c in columns]
    base = df.select(
        *[
            (ref(c) if same else ref(c).cast("string")).alias(f"c{i}", metadata={})
            for i, c in enumerate(columns)
        ]
    )
    names = base.columns
    weight: Column = F.count("*")
    if all(arities) and prod(a + 1 for a in arities) <= TUPLE_LIMIT:
        base = base.groupBy(*names).agg(F.count("*").alias("n"))
        weight = F.sum("n")
    else:
        blocks = column_blocks(arities)
        if 2 <= len(blocks) < len(columns):
            return _blocked_pair_counts(base, columns, blocks)
        base = base.select("*", F.lit(1).alias("n"))
    pairs = list(combinations(range(len(columns)), 2))
    flat = (
        base.select(
            "n",
            *[
                F.struct(F.col(f"c{i}").alias("vi"), F.col(f"c{j}").alias("vj")).alias(f"p{k}")
                for k, (i, j) in enumerate(pairs)
            ],
        )
        .unpivot(["n"], [f"p{k}" for k in range(len(pairs))], "pair", "v")
        .select("n", "pair", "v.vi", "v.vj")
        .where("vi is not null and vj is not null")
    )
    return _mirrored(flat.groupBy("pair", "vi", "vj").agg(weight.alias("count")), columns, pairs)


def column_blocks(arities: list[int | None], limit: int = isqrt(TUPLE_LIMIT)) -> list[list[int]]:
    """Places of columns in blocks of at most ``limit`` value combinations, a null counting as a value. Columns of similar
    arity are put together; one of unknown or greater arity is a block by itself."""
    known = sorted((k for k, a in enumerate(arities) if a), key=lambda k: (arities[k], k))
    blocks: list[list[int]] = [[k] for k, a in enumerate(arities) if not a]
    room = 0
    for k in known:
        size = arities[k] + 1
        if size <= room:
            blocks[-1].append(k)
            room //= size
        else:
            blocks.append([k])
            room = limit // size
    return blocks


def _blocked_pair_counts(base: DataFrame, columns: list[str], blocks: list[list[int]]) -> DataFrame:
    """``pair_counts`` by the tuples of every two blocks. Pairs within a block come from its first two."""
    element = base.schema[0].dataType.simpleString()
    tuples, places, done = [], [], set()
    for a, b in combinations(range(len(blocks)), 2):
        members = blocks[a] + blocks[b]
        at = {c: k + 1 for k, c in enumerate(members)}
        new = [(min(x, y), max(x, y)) for x, y in combinations(members, 2)]
        new = [xy for xy in new if xy not in done]
        done.update(new)
        places.append([{"i": x + 1, "j": y + 1, "a": at[x], "b": at[y]} for x, y in new])
        tuples.append(F.array(*[F.col(f"c{c}") for c in members]).cast(f"array<{element}>").alias(str(len(tuples) + 1)))
    counted = (
        base.select(*tuples)
        .unpivot([], [ref(str(k + 1)) for k in range(len(tuples))], "two", "t")
        .groupBy("two", "t").agg(F.count("*").alias("n"))
    )
    # one small list for every two blocks, folded into a literal
    spec = F.from_json(F.lit(json.dumps(places)), "array<array<struct<i:int,j:int,a:int,b:int>>>")
    flat = (
        counted.select("n", "t", F.explode(F.element_at(spec, F.col("two").cast("int"))).alias("p"))
        .select("n", "p.i", "p.j", F.element_at("t", F.col("p.a")).alias("vi"), F.element_at("t", F.col("p.b")).alias("vj"))
        .where("vi is not null and vj is not null")
    )
    summed = flat.groupBy("i", "j", "vi", "vj").agg(F.sum("n").alias("count"))
    names = F.array(*map(F.lit, columns))
    a, b = F.element_at(names, F.col("i")), F.element_at(names, F.col("j"))
    return _both_ways(summed, a, b)


def _mirrored(counted: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Counts of both orders of each pair, with the columns' names."""
    left = [x for k, (i, _) in enumerate(pairs) for x in (F.lit(f"p{k}"), F.lit(columns[i]))]
    right = [x for k, (_, j) in enumerate(pairs) for x in (F.lit(f"p{k}"), F.lit(columns[j]))]
    a = F.element_at(F.create_map(*left), F.col("pair"))
    b = F.element_at(F.create_map(*right), F.col("pair"))
    return _both_ways(counted, a, b)


def _both_ways(counted: DataFrame, a: Column, b: Column) -> DataFrame:
    """``ci, cj, vi, vj, count`` in both orders; a, b: the names of the columns of ``vi`` and ``vj``."""

    def row(ci: Column, cj: Column, vi: str, vj: str) -> Column:
        return F.struct(
            ci.alias("ci"), cj.alias("cj"), F.col(vi).alias("vi"), F.col(vj).alias("vj"), F.col("count")
        )

    return counted.select(F.inline(F.array(row(a, b, "vi", "vj"), row(b, a, "vj", "vi"))))


def term_shares(df: DataFrame, column: str) -> Column:
    """``array<struct<v, w>>``: the distinct values of a row, each with its share of the row. A single value has a
    share of one; nulls have none."""
    c = ref(column)
    if not is_term_array(dtype(df, column)):
        one = F.struct(c.cast("string").alias("v"), F.lit(1.0).alias("w"))
        return F.array_compact(F.array(F.when(c.isNotNull(), one)))
    terms = F.array_distinct(F.array_compact(c))
    return F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.struct(t.alias("v"), (F.lit(1.0) / F.size(terms)).alias("w")))


def _shared_pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``pair_counts`` by shares. A row's pairs of terms are made one after the other, never as one array, and are combined
    before the shuffle."""
    base = df.select(*[term_shares(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    flat = (
        base.select(*[F.struct(F.col(f"c{i}").alias("i"), F.col(f"c{j}").alias("j")).alias(f"p{k}") for k, (i, j) in enumerate(pairs)])
        .unpivot([], [f"p{k}" for k in range(len(pairs))], "pair", "v")
        .select("pair", F.explode("v.i").alias("i"), F.col("v.j").alias("j"))
        .select("pair", "i", F.explode("j").alias("j"))
    )
    counted = flat.groupBy("pair", F.col("i.v").alias("vi"), F.col("j.v").alias("vj")).agg(
        F.sum(F.col("i.w") * F.col("j.w")).alias("count")
    )
    return _mirrored(counted, columns, pairs)
