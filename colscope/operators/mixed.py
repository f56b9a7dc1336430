"""Distances between values of a column from how they occur with the values of other columns.

P(w|x) is the share of column-j value w among the rows with column-i value x. Two values are as far
apart as these shares differ, averaged over the other columns (Ahmad and Dey, Data & Knowledge
Engineering 63, 2007). The sum over w of max(P(w|x), P(w|y)) is 2 minus the sum of the smaller ones,
so only values that do occur together with both x and y need to be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.columns import ref, require_present
from colscope.constants import DISTANCE_BINS
from colscope.operators.aggregates import pair_counts, term_shares
from colscope.session import forget, written

# Values that may meet in one group of the pair join; larger groups are sliced.
GROUP_SIZE = 4_096
# Values of a block, and their shares, of which every two blocks are compared in one task; a column is cut further, for all tasks
# to have work, as long as blocks have so many values.
BLOCK_VALUES = 131_072
BLOCK_SHARES = 2_000_000
LEAST_VALUES = 1_024
# Sums held at a time, and candidates of the other side.
CELL = 1 << 18
HELD = 1 << 20


def conditional_proba(pairs: DataFrame) -> DataFrame:
    """``ci, vi, cj, vj, p`` from pair counts; for each (ci, vi, cj) the p add up to one."""
    # summed before the shuffle and joined back: no task needs all partners of a frequent value
    totals = pairs.groupBy("ci", "cj", "vi").agg(F.sum("count").alias("_total"))
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in ("ci", "cj", "vi")], "_total")
    # columns have names; by plain equality a choice among them is known on both sides of the join
    same = [F.col("ci") == F.col("_ci"), F.col("cj") == F.col("_cj"), F.col("vi").eqNullSafe(F.col("_vi"))]
    return pairs.join(totals, reduce(and_, same)).select(
        "ci", "vi", "cj", "vj", (F.col("count") / F.col("_total")).alias("p")
    )


def _with_listing(proba: DataFrame) -> DataFrame:
    """Add one row per value, under a column name of its own, in which all values of a column meet.

    It makes value pairs appear that share nothing. It comes from the same rows as the shares, so the
    counts behind them are not computed a second time.
    """
    place = F.row_number().over(Window.partitionBy("ci", "vi").orderBy("cj", "vj"))
    none = F.struct(F.lit("").alias("cj"), F.lit(None).alias("vj"), F.lit(0.0).alias("p"))
    rows = F.array_compact(F.array(F.struct("cj", "vj", "p"), F.when(F.col("place") == 1, none)))
    return proba.withColumn("place", place).select("ci", "vi", F.inline(rows))


def _sliced(shares: DataFrame) -> DataFrame:
    """Cut the groups whose values are to be paired into slices, so that no task pairs a large one.

    A group of g values gets s = ceil(g / GROUP_SIZE) slices and one cell per unordered pair of slices.
    Each value is sent to the s cells of its slice. Two values meet in the cell of their two slices;
    ``_pairs_of`` skips the other cells two values of one slice share.
    """
    sizes = shares.groupBy("ci", "cj", "vj").agg(F.ceil(F.count("*") / F.lit(GROUP_SIZE)).cast("int").alias("slices"))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in ("ci", "cj", "vj")], "slices")
    out = shares.join(sizes, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("ci", "cj", "vj")]))
    out = out.withColumn("slice", F.pmod(F.xxhash64("vi"), F.col("slices")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return out.select(
        "ci", "cj", "vj", "vi", "p", "slice",
        F.least("slice", "other").alias("cell_a"), F.greatest("slice", "other").alias("cell_b"),
    )


def _pairs_of(rows: DataFrame) -> DataFrame:
    """``column, vx, vy, low`` for every two values that meet; both sides are one shuffled table."""
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("ci", "cj", "cell_a", "cell_b")]
    same.append(F.col("x.vj").eqNullSafe(F.col("y.vj")))
    once = (F.col("x.slice") != F.col("y.slice")) | (F.col("x.cell_a") == F.col("x.cell_b"))
    met = x.join(y, reduce(and_, same) & (F.col("x.vi") < F.col("y.vi")) & once)
    return met.select(
        F.col("x.ci").alias("column"), F.col("x.vi").alias("vx"), F.col("y.vi").alias("vy"),
        F.least("x.p", "y.p").alias("low"),
    )


def value_distance(proba: DataFrame, columns: int) -> DataFrame:
    """``column, vx, vy, cooccurrence, distance`` for every two values vx < vy of each column.

    ``columns`` is the number of columns compared. ``distance`` lies between 0 and 1 and is
    ``cooccurrence - 1``. The result itself lists value pairs, so the columns should be encoded
    ones (leading terms plus ``others``, or bins); nothing after the pair counts depends on the number
    of rows.
    """
    if columns < 2:
        raise ValueError("a distance needs at least two columns")
    met = _pairs_of(_sliced(_with_listing(proba)))
    low = met.groupBy("column", "vx", "vy").agg(F.sum("low").alias("low"))
    # identical distributions can end up a rounding error below zero
    distance = F.greatest(F.lit(1.0) - F.col("low") / F.lit(columns - 1), F.lit(0.0))
    return low.select(
        "column", "vx", "vy", (distance + 1).alias("cooccurrence"), distance.alias("distance")
    )


def requested_distance(proba: DataFrame, columns: int, pairs: DataFrame) -> DataFrame:
    """``value_distance`` for the pairs asked for, as ``column, vx, vy`` rows (repeated ones once).

    Shares are looked up by value, so the cost follows the pairs and the values that occur with
    them, however many values the columns have. A value that never occurs shares nothing.
    """
    if columns < 2:
        raise ValueError("a distance needs at least two columns")
    asked = pairs.select("column", "vx", "vy").distinct()
    x = proba.select(F.col("ci").alias("column"), F.col("vi").alias("vx"), "cj", "vj", F.col("p").alias("px"))
    y = proba.select(F.col("ci").alias("_c"), F.col("vi").alias("_v"), F.col("cj").alias("_cj"), F.col("vj").alias("_vj"), F.col("p").alias("py"))
    met = asked.join(x, ["column", "vx"]).join(
        y, (F.col("column") == F.col("_c")) & (F.col("vy") == F.col("_v")) & (F.col("cj") == F.col("_cj")) & (F.col("vj") == F.col("_vj"))
    )
    low = met.groupBy("column", "vx", "vy").agg(F.sum(F.least("px", "py")).alias("low"))
    distance = F.greatest(F.lit(1.0) - F.coalesce("low", F.lit(0.0)) / F.lit(columns - 1), F.lit(0.0))
    return asked.join(low, ["column", "vx", "vy"], "left").select(
        "column", "vx", "vy", (distance + 1).alias("cooccurrence"), distance.alias("distance")
    )


def _packed(proba: DataFrame) -> DataFrame:
    """``ci, block, x, size, f, p``: values of a column in blocks of about ``BLOCK_VALUES`` at most, or fewer when they have many
    shares. A block's values ascend; ``f`` are the hashes of what they are shares of, value after value, as little-endian bytes."""
    spark = proba.sparkSession
    mine = proba.where(F.col("ci").isNotNull() & F.col("vi").isNotNull())
    mine = mine.groupBy("ci", F.col("vi").alias("x")).agg(F.collect_list(F.struct(F.xxhash64("cj", "vj").alias("f"), "p")).alias("e"))
    # each value's shares are gathered once; their number is bounded by the values of the other columns
    entries = written(mine, "entries")
    sizes = entries.groupBy("ci").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("e")).alias("m"))
    # every two blocks are a task: four for each core, unless the column is short
    wanted = F.least(F.lit(float(isqrt(4 * spark.sparkContext.defaultParallelism) + 1)), F.col("n") / F.lit(LEAST_VALUES))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(BLOCK_VALUES), F.col("m") / F.lit(BLOCK_SHARES), wanted)).cast("int")
    mine = entries.join(F.broadcast(sizes.select("ci", blocks.alias("blocks"))), "ci")
    mine = mine.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).drop("blocks")
    kind = mine.schema["x"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("x").combine_chunks()
        e = t.column("e").combine_chunks()
        flat = e.flatten()
        f, p = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        x = t.column("x").combine_chunks()
        parts = [e.value_lengths().to_numpy().astype("<i8"), f.astype("<i8"), p.astype("<f8")]
        first = t.select(["ci", "block"]).slice(0, 1)
        first = first.append_column("x", pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
        for name, part in zip(("size", "f", "p"), parts):
            first = first.append_column(name, pa.array([part.tobytes()], pa.binary()))
        return first

    packed = written(mine.groupBy("ci", "block").applyInArrow(pack, f"ci string, block int, x array<{kind}>, size binary, f binary, p binary"), "blocks")
    forget(entries)
    return packed


def _first_of(at: np.ndarray, other: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, other, v): for each ``at`` the ``n`` greatest v, ties to the smaller ``other``."""
    o = np.lexsort((other, -v, at))
    at, other, v = at[o], other[o], v[o]
    first = np.arange(len(at)) - np.searchsorted(at, at) < n
    return at[first], other[first], v[first]


def _best_of_both(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], n: int, same: bool) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(place in x, place in y, overlap) of the ``n`` best of block y for each value of block x, and the other way round; ties to the smaller place.

    A block is ``size, f, p``. Some values of x at a time meet the shares of y that are of the same, whose smaller sides are summed. The
    sum of two values serves both; ``same`` blocks are compared from one side only.
    """
    (xn, xf, xp), (yn, yf, yp) = x, y
    order = np.argsort(yf, kind="stable")
    yf, yp, held = yf[order], yp[order], np.repeat(np.arange(len(yn)), yn)[order]
    low, high = np.searchsorted(yf, xf), np.searchsorted(yf, xf, "right")
    met, begin = high - low, np.concatenate([[0], np.cumsum(xn)])
    ends = np.concatenate([[0], np.cumsum(met)])[begin]
    width = len(yn)
    rows = max(1, CELL // max(1, width))
    # the n-th best of the greatest of some groups of values of y is no better than the n-th best of all
    groups = np.linspace(0, width, min(width, max(64, 4 * n)), endpoint=False, dtype=np.int64)
    mine, theirs = [], [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)]]
    least, waiting, a = np.zeros(width), 0, 0
    while a < len(xn):
        # as many values as keep sums and meetings within a bounded size
        b = min(len(xn), a + rows, max(a + 1, int(np.searchsorted(ends, ends[a] + CELL, "right")) - 1))
        i, j = begin[a], begin[b]
        m = met[i:j]
        at = np.arange(int(m.sum()))
        at += np.repeat(low[i:j] - np.cumsum(m) + m, m)
        cell = held[at]
        cell += np.repeat(np.repeat(np.arange(b - a) * width, xn[a:b]), m)
        sums = np.bincount(cell, np.minimum(np.repeat(xp[i:j], m), yp[at]), (b - a) * width).reshape(b - a, width)
        if same:
            sums[np.arange(b - a), np.arange(a, b)] = 0.0
        # all limits leave room for rounding; what is below is no candidate of either side
        top = np.maximum.reduceat(sums, groups, axis=1)
        k = len(groups) - n
        limit = np.maximum(np.partition(top, k, axis=1)[:, k] - 1e-9, 0.0) if k >= 0 else np.zeros(b - a)
        at = np.flatnonzero(sums > (limit[:, None] if same else np.minimum(limit[:, None], least)))
        v, r = sums.ravel()[at], at // width
        c, own = at - r * width, v > limit[r]
        # rounded so that their order is that of the shares, not of the rows
        v = np.floor(v * 1e9 + 0.5) / 1e9
        mine.append(_first_of(r[own] + a, c[own], v[own], n))
        if not same:
            # of equal overlaps the earlier value of x was the first to be found
            later = v > least[c]
            theirs.append([c[later], r[later] + a, v[later]])
            waiting += int(later.sum())
            if waiting > HELD or b == len(xn):
                theirs = [list(_first_of(*[np.concatenate(z) for z in zip(*theirs)], n))]
                full, of = np.unique(theirs[0][0], return_counts=True)
                full = full[of == n]
                least[full] = theirs[0][2][np.searchsorted(theirs[0][0], full) + n - 1]
                waiting = 0
        a = b
    return tuple(np.concatenate(z) for z in zip(*mine)), tuple(theirs[0])


def _best_of(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], n: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, overlap) of the ``n`` best of block y for each value of block x (see ``_best_of_both``)."""
    return _best_of_both(x, y, n, same)[0]


def nearest_values(proba: DataFrame, columns: int, n: int = 10) -> DataFrame:
    """``column, value, rank, nearest, distance``: for each value the ``n`` values of its column at the smallest distance
    (see ``value_distance``), ties to the smaller one. Values that share nothing, at distance one, are not listed.

    The answer is exact. Values are packed into blocks, every two blocks of a column meet in a task of their own, and it keeps the ``n`` best of either block
    for each value of the other: no pair of values is ever a row of a shuffle. Blocks are shuffled once, one to a partition, and every task fetches
    its two, so the disk holds each but once. The work is quadratic where all values share something.
    """
    if columns < 2:
        raise ValueError("a distance needs at least two columns")
    blocks = _packed(proba)
    kind = blocks.schema["x"].dataType.elementType.simpleString()
    # a row per column: where its blocks are in the order of all
    known = blocks.groupBy("ci").agg(F.max("block").alias("last")).orderBy("ci").collect()
    starts, total = [], 0
    for r in known:
        starts += [F.lit(r["ci"]), F.lit(total)]
        total += r["last"] + 1
    place = F.element_at(F.create_map(*starts), F.col("ci")) + F.col("block") if starts else F.lit(0)
    # as many partitions as places, in their order: one block to each
    side = blocks.withColumn("place", place).repartitionByRange(max(1, total), "place")
    one, two = (side.select(*[F.col(c).alias(f"{c}{k}") for c in side.columns if c != "block"]) for k in "xy")
    # of (a, b) and (b, a) one, so that no block is the first, or the second, of most
    once = (F.col("placex") < F.col("placey")) == ((F.col("placex") + F.col("placey")) % 2 == 1)
    cells = one.hint("shuffle_replicate_nl").join(two, (F.col("cix") == F.col("ciy")) & (once | (F.col("placex") == F.col("placey"))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                sides = [[np.frombuffer(b.column(f"{c}{s}")[0].as_py(), t) for c, t in (("size", "<i8"), ("f", "<i8"), ("p", "<f8"))] for s in "xy"]
                names = [b.column(f"x{s}").flatten() for s in "xy"]
                found = _best_of_both(*sides, n, b.column("placex")[0] == b.column("placey")[0])
                for (i, j, low), left, right in zip(found, names, names[::-1]):
                    ci = pa.array([b.column("cix")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(i), np.int64)))
                    out = pa.RecordBatch.from_arrays([ci, left.take(pa.array(i)), right.take(pa.array(j)), pa.array(low)], ["ci", "x", "y", "low"])
                    for at in range(0, len(i), HELD):
                        yield out.slice(at, HELD)

    found = cells.mapInArrow(best, f"ci string, x {kind}, y {kind}, low double")
    order = Window.partitionBy("ci", "x").orderBy(F.desc("low"), "y")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    distance = F.greatest(F.lit(1.0) - F.col("low") / F.lit(columns - 1), F.lit(0.0))
    return found.select(F.col("ci").alias("column"), F.col("x").alias("value"), "rank", F.col("y").alias("nearest"), distance.alias("distance"))


def row_distance(df: DataFrame, key: str, column: str, pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """``x, y, distance`` for the pairs ``x, y`` of rows asked for (repeated ones once), named by ``key``.

    A row stands for the distinct values it has in ``column``, a single one or an array, with equal shares. The distance of
    two rows is the mean distance of a value of one and a value of the other, as often as they have them; that of a row
    and itself is thus not zero unless its values are alike. ``distances`` are those of ``value_distance`` or
    ``requested_distance`` with ``column, vx, vy, distance``, vx < vy; equal values are at distance zero. Pairs with a row that has no
    value, or with a pair of values that ``distances`` does not list, have none.
    """
    require_present(df, [key, column])
    asked = pairs.select("x", "y").distinct()
    held = df.select(ref(key).alias("_key"), F.inline(term_shares(df, column)))
    x = held.select(F.col("_key").alias("x"), F.col("v").alias("vx"), F.col("w").alias("wx"))
    y = held.select(F.col("_key").alias("y"), F.col("v").alias("vy"), F.col("w").alias("wy"))
    met = asked.join(x, ["x"]).join(y, ["y"])
    known = distances.where(F.col("column") == column).select(
        F.col("vx").alias("_low"), F.col("vy").alias("_high"), F.col("distance").alias("_distance")
    )
    met = met.join(known, (F.least("vx", "vy") == F.col("_low")) & (F.greatest("vx", "vy") == F.col("_high")), "left")
    far = F.when(F.col("vx") == F.col("vy"), F.lit(0.0)).otherwise(F.col("_distance"))
    found = met.groupBy("x", "y").agg(
        F.sum(F.col("wx") * F.col("wy") * far).alias("distance"), F.count_if(far.isNull()).alias("_unknown")
    )
    found = found.select("x", "y", F.when(F.col("_unknown") == 0, F.col("distance")).alias("distance"))
    return asked.join(found, ["x", "y"], "left")


def significance(proba: DataFrame, columns: int, bins: int = DISTANCE_BINS) -> DataFrame:
    """``column, significance, significance_raw``: distances (and co-occurrences) of a column's value
    pairs, summed and divided by the number of bin pairs.

    No pairs are formed: among shares sorted upwards, the k-th of n is the smaller one in its pairs
    with the n - k above it, so it is counted that often.
    """
    if columns < 2:
        raise ValueError("a distance needs at least two columns")
    group = Window.partitionBy("ci", "cj", "vj")
    above = F.count("*").over(group) - F.row_number().over(group.orderBy("p", "vi"))
    low = (
        proba.select("ci", "vi", (F.col("p") * above).alias("low"))
        .groupBy(F.col("ci").alias("column"))
        .agg(F.sum("low").alias("low"), F.count_distinct("vi").alias("n"))
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    total = F.greatest(pairs - F.col("low") / F.lit(columns - 1), F.lit(0.0))
    per = F.lit(bins * (bins - 1) / 2)
    return low.select(
        "column", (total / per).alias("significance"), ((total + pairs) / per).alias("significance_raw")
    )


def only_columns(frame: DataFrame, names: list[str]) -> DataFrame:
    """Rows about the named columns."""
    return frame.where(F.col("column").isin(names))


@dataclass
class MixedDistance:
    """Result of ``mixed_distance``."""

    cooccurrences: DataFrame
    significances: DataFrame
    proba: DataFrame
    _stored: DataFrame

    def release(self) -> None:
        """Free the stored pair counts once the results are written or no longer needed."""
        self._stored.unpersist()


def mixed_distance(
    df: DataFrame, quali: list[str], quanti: list[str], bins: int = DISTANCE_BINS, store: bool = True
) -> MixedDistance:
    """Value distances of the qualitative columns and significances of the quantitative ones.

    ``quali`` are indexed columns, or arrays of terms, and ``quanti`` bucketized ones. All take part in every
    distance; a row counts towards its terms in equal shares.
    The pair counts are the only pass over the table; they are stored (their size depends on the
    number of values, not rows) and feed both results. ``store=False`` suits callers of one result,
    who then have nothing to release.
    """
    columns = [*quali, *quanti]
    require_present(df, columns)
    pairs = pair_counts(df, columns)
    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK) if store else pairs
    proba = conditional_proba(pairs)
    quali_p = proba.where(F.col("ci").isin(quali))
    quanti_p = proba.where(F.col("ci").isin(quanti))
    return MixedDistance(
        value_distance(quali_p, len(columns)),
        significance(quanti_p, len(columns), bins),
        proba,
        pairs,
    )
