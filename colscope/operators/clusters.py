"""Clustering of rows with numeric and categorical columns.

A centre holds a mean per number and the share of every value per category. A row is as far from it as

    sum over numbers    (significance * (scaled value - mean))^2
  + sum over categories (sum over values v of share(v) * distance(value, v))^2

Means are few and written into the plan. Shares, and what a value costs against each centre, are frames with a row per value,
however many there are; costs of at most ``HOT_CATEGORIES`` values in all are written into the plan as well. The costs need no distances of value pairs: with P(u|v) the share of another column's value u
among the rows with v, the distance of v and w is one less the mean over the other columns of the sum over u of
min(P(u|v), P(u|w)). Among the values that occur with u, in the order of P, the smaller ones add their own P and
the larger ones add P(u|v), each as often as the centre has them; so running sums give the cost.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property, reduce
from math import prod
from operator import add

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.columns import ref, require_new, require_present
from colscope.constants import CLUSTER_SEED, CLUSTERS
from colscope.operators.aggregates import TUPLE_LIMIT, known_arity
from colscope.operators.encode import numeric_bounds
from colscope.operators.lookup import HOT_CATEGORIES, look_up
from colscope.operators.mixed import mixed_distance, value_distance
from colscope.session import written


@dataclass(frozen=True)
class Centre:
    """Means of the scaled numbers and value shares of the categories, in column order."""

    means: tuple[float, ...]
    shares: tuple[tuple[float, ...], ...]


@dataclass(eq=False)
class MixedClusters:
    """Fitted centres; ``assign`` adds the nearest one to any table with the same columns.

    ``means`` has a tuple per centre. ``shares`` is the frame ``position, value, cluster, share`` (a category's place among the
    columns, its index, the centre), ``costs`` has ``position, value`` and a column per centre.
    """

    quali: list[str]
    quanti: list[str]
    bounds: dict[str, tuple[float, float]]
    weights: tuple[float, ...]
    sizes: list[int]
    entries: DataFrame | None
    means: list[tuple[float, ...]]
    shares: DataFrame | None
    costs: DataFrame | None
    rounds: int = 0
    converged: bool = False
    _columns: int = field(default=2, repr=False)
    _few: list[list[list[float]]] | None = field(default=None, repr=False)

    @property
    def few_values(self) -> bool:
        """Whether the values of all categories are no more than a single column may broadcast anyway."""
        return sum(self.sizes) <= HOT_CATEGORIES

    @property
    def k(self) -> int:
        return len(self.means)

    @cached_property
    def centres(self) -> tuple[Centre, ...]:
        """The centres as numbers, for models with few values; for others read ``shares``."""
        found: dict = defaultdict(float)
        if self.shares is not None:
            for r in self.shares.collect():
                found[r["cluster"], r["position"], int(r["value"])] = r["share"]
        return tuple(
            Centre(m, tuple(tuple(found[c, i, v] for v in range(n)) for i, n in enumerate(self.sizes)))
            for c, m in enumerate(self.means)
        )

    @cached_property
    def tables(self) -> tuple[tuple[tuple[float, ...], ...], ...]:
        """All value distances per category, for models with few values; the clusters do without them."""
        tables = [[[0.0] * n for _ in range(n)] for n in self.sizes]
        if self.entries is not None:
            proba = self.entries.withColumnsRenamed({"position": "ci", "value": "vi"})
            for r in value_distance(proba.withColumn("ci", F.col("ci").cast("string")), self._columns).collect():
                t, x, y = tables[int(r["column"])], int(r["vx"]), int(r["vy"])
                t[x][y] = t[y][x] = r["distance"]
        return tuple(tuple(tuple(row) for row in t) for t in tables)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``cluster`` and ``cluster_distance``."""
        require_present(df, [*self.quali, *self.quanti])
        require_new(df, ["cluster", "cluster_distance"])
        numbers = [_scaled(c, self.bounds[c]) for c in self.quanti]
        far = _distances(self, df, numbers, [ref(c) for c in self.quali])
        nearest = F.array_min("_far")
        return far.select(
            *[ref(c) for c in df.columns],
            (F.array_position("_far", nearest) - 1).cast("int").alias("cluster"),
            nearest.alias("cluster_distance"),
        )


def _scaled(column: str, bounds: tuple[float, float]) -> Column:
    lo, hi = bounds
    v = ref(column).cast("double")
    return (v - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.when(v.isNotNull(), F.lit(0.5))


def _distances(model: MixedClusters, rows: DataFrame, numbers: list[Column], values: list[Column]) -> DataFrame:
    """``rows`` with ``_far``, their distance to each centre; a missing value adds nothing to any of them."""
    terms: list[list[Column]] = [
        [F.coalesce(F.pow(F.lit(w) * (x - F.lit(m)), 2), F.lit(0.0)) for x, w, m in zip(numbers, model.weights, means)]
        for means in model.means
    ]
    if model._few is not None:
        for v, found in zip(values, model._few):
            for c, costs in enumerate(found):
                terms[c].append(F.coalesce(F.get(F.array(*[F.lit(x) for x in costs]), v.cast("int")), F.lit(0.0)))
        return rows.select("*", F.array(*[reduce(add, t) for t in terms]).alias("_far"))
    out = rows.select("*", *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    for i, size in enumerate(model.sizes):
        names = [f"_cost_{i}_{c}" for c in range(model.k)]
        mine = model.costs.where(F.col("position") == i)
        mine = mine.select("value", *[F.col(f"c{c}").alias(n) for c, n in enumerate(names)])
        out = look_up(out, {"value": F.col(f"_v{i}")}, mine, names, size)
        for c, name in enumerate(names):
            terms[c].append(F.coalesce(name, F.lit(0.0)))
    return out.select(*[ref(c) for c in rows.columns], F.array(*[reduce(add, t) for t in terms]).alias("_far"))


def value_costs(entries: DataFrame, shares: DataFrame, k: int, columns: int) -> DataFrame:
    """``position, value, c0, c1, ...``: what each value costs against each of ``k`` centres.

    ``entries`` are conditional shares (``position, value, cj, vj, p``), ``shares`` those of the centres. ``columns`` is the
    number of columns compared.
    """
    centre = [F.sum(F.when(F.col("cluster") == c, F.col("share"))).alias(f"s{c}") for c in range(k)]
    held = shares.groupBy("position", "value").agg(*centre).fillna(0.0)
    sums = shares.groupBy("position").agg(*[s.alias(f"t{c}") for c, s in enumerate(centre)]).fillna(0.0)
    e = entries.join(held, ["position", "value"], "left").fillna(0.0, [f"s{c}" for c in range(k)])
    group = Window.partitionBy("position", "cj", "vj")
    up_to = group.orderBy("p")  # values of equal p count together
    low = [
        F.sum(F.col(f"s{c}") * F.col("p")).over(up_to)
        + F.col("p") * (F.sum(f"s{c}").over(group) - F.sum(f"s{c}").over(up_to))
        for c in range(k)
    ]
    found = e.select("position", "value", *[x.alias(f"l{c}") for c, x in enumerate(low)])
    found = found.groupBy("position", "value").agg(*[F.sum(f"l{c}").alias(f"l{c}") for c in range(k)])
    mean = [F.greatest(F.col(f"t{c}") - F.col(f"l{c}") / F.lit(columns - 1), F.lit(0.0)) for c in range(k)]
    return found.join(F.broadcast(sums), ["position"]).select("position", "value", *[F.pow(m, 2).alias(f"c{c}") for c, m in enumerate(mean)])


def _seeds(base: DataFrame, k: int, seed: int) -> list:
    """k rows with the smallest distinct hash of their values: random, repeatable, never two copies."""
    keyed = base.select(F.xxhash64(F.lit(seed), *base.columns).alias("h"), F.struct(*base.columns).alias("row"))
    found, last = [], None
    for _ in range(k):
        rest = keyed if last is None else keyed.where(F.col("h") > last)
        r = rest.agg(F.min(F.struct("h", "row")).alias("m")).first()["m"]
        if r is None:
            break
        last = r["h"]
        found.append(r["row"])
    return found


def fit_mixed_clusters(
    df: DataFrame,
    quali: list[str],
    quanti: list[str],
    k: int = CLUSTERS,
    seed: int = CLUSTER_SEED,
    max_rounds: int = 10,
    tolerance: float = 1e-9,
) -> MixedClusters:
    """Fit k centres. ``quali`` are indexed columns; each ``quanti`` column comes with its ``<col>-bucketized`` one,
    from which its significance is measured.

    A round looks up the costs of the rows' values, finds the nearest centres, and writes the counts of the new ones, so
    plans do not grow from round to round. What reaches the driver are means and one difference. ``converged`` tells
    whether the centres had come to rest before ``max_rounds``.
    """
    bins = [f"{c}-bucketized" for c in quanti]
    require_present(df, [*quali, *quanti, *bins])
    sizes = [known_arity(df, c) for c in quali]
    if None in sizes:
        raise ValueError("qualitative columns must be indexed and carry their labels")
    columns = len(quali) + len(bins)
    measured = mixed_distance(df, quali, bins)
    try:
        found = {r["column"]: r["significance"] for r in measured.significances.collect()}
        entries = _entries(measured.proba, quali) if quali else None
    finally:
        measured.release()
    bounds = numeric_bounds(df, quanti) if quanti else {}
    bounds = {c: (lo or 0.0, hi or 0.0) for c, (lo, hi) in bounds.items()}
    numbers = [f"x{i}" for i in range(len(quanti))]
    values = [f"v{i}" for i in range(len(quali))]
    weights = tuple(found.get(b, 0.0) for b in bins)
    model = MixedClusters(quali, quanti, bounds, weights, sizes, entries, [], None, None, _columns=columns)
    base = df.select(
        *[_scaled(c, bounds[c]).alias(n) for c, n in zip(quanti, numbers)],
        *[ref(c).cast("double").alias(n) for c, n in zip(quali, values)],
    ).hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = _seeds(base, k, seed)
        model.means = [tuple(float(r[n] or 0.0) for n in numbers) for r in rows]
        first = [(i, r[v], c, 1.0) for c, r in enumerate(rows) for i, v in enumerate(values) if r[v] is not None]
        _place(model, df.sparkSession.createDataFrame(first, "position int, value double, cluster int, share double"))
        model.converged = not rows
        while model.rounds < max_rounds and model.means and not model.converged:
            means, shares = _move(base, model, numbers, values)
            model.rounds += 1
            still = all(abs(x - y) <= tolerance for a, b in zip(model.means, means) for x, y in zip(a, b))
            model.converged = still and (not quali or _change(model.shares, shares) <= tolerance)
            model.means = means
            _place(model, shares)
    finally:
        base.unpersist()
    return model


def _entries(proba: DataFrame, quali: list[str]) -> DataFrame:
    place = F.element_at(F.create_map(*[x for i, c in enumerate(quali) for x in (F.lit(c), F.lit(i))]), F.col("ci"))
    mine = proba.where(F.col("ci").isin(quali) & F.col("vi").isNotNull())
    return written(mine.select(place.alias("position"), F.col("vi").cast("double").alias("value"), "cj", "vj", "p"), "entries")


def _place(model: MixedClusters, shares: DataFrame) -> None:
    model.shares = shares
    if not model.quali or not model.means:
        return
    model.costs = value_costs(model.entries, shares, model.k, model._columns)
    if not model.few_values:
        model.costs = written(model.costs, "costs")
        return
    few = [[[0.0] * n for _ in model.means] for n in model.sizes]
    for r in model.costs.collect():
        for c in range(model.k):
            few[r["position"]][c][int(r["value"])] = r[f"c{c}"]
    model._few = few


def _change(old: DataFrame, new: DataFrame) -> float:
    """Largest difference of a share."""
    both = old.withColumnRenamed("share", "a").join(new.withColumnRenamed("share", "b"), ["position", "value", "cluster"], "full")
    off = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg(F.max(off).alias("m")).first()["m"] or 0.0


def _move(base: DataFrame, model: MixedClusters, numbers: list[str], values: list[str]) -> tuple[list, DataFrame]:
    """Means and shares of the rows nearest to each current centre; a centre without rows stays."""
    far = _distances(model, base, [F.col(n) for n in numbers], [F.col(v) for v in values])
    near = far.select(
        *numbers, *values, (F.array_position("_far", F.array_min("_far")) - 1).cast("int").alias("cluster")
    )
    # One pass: every row counts towards its cluster, and towards (cluster, value) per category. Where
    # value combinations are few, they are counted first and the rest works on those counts.
    sums = [F.sum(n).alias(n) for n in numbers] + [F.count(n).alias(f"n_{n}") for n in numbers]
    if prod(size + 1 for size in model.sizes) * model.k <= TUPLE_LIMIT:
        near = near.groupBy("cluster", *values).agg(F.count("*").alias("n"), *sums)
        sums = [F.sum(c).alias(c) for n in numbers for c in (n, f"n_{n}")]
    else:
        near = near.withColumn("n", F.lit(1))
    sets = [["cluster"], *[["cluster", v] for v in values]]
    tags = [F.grouping(v).alias(f"g_{v}") for v in values]
    found = near.groupingSets([[F.col(c) for c in s] for s in sets], "cluster", *values).agg(
        F.sum("n").alias("n"), *sums, *tags
    )
    position = F.coalesce(*[F.when(F.col(f"g_{v}") == 0, F.lit(i)) for i, v in enumerate(values)]) if values else F.lit(None)
    value = F.coalesce(*[F.when(F.col(f"g_{v}") == 0, F.col(v)) for v in values]) if values else F.lit(None)
    found = found.select("cluster", position.cast("int").alias("position"), value.cast("double").alias("value"), "n", *numbers, *[f"n_{n}" for n in numbers])
    found = written(found, "centres")
    by_cluster = {
        r["cluster"]: tuple(r[n] / r[f"n_{n}"] if r[f"n_{n}"] else 0.0 for n in numbers)
        for r in found.where("position IS NULL").collect()
    }
    means = [by_cluster.get(c, old) for c, old in enumerate(model.means)]
    counts = found.where("position IS NOT NULL AND value IS NOT NULL")
    totals = counts.groupBy("position", "cluster").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["position", "cluster"])
    shares = shares.select("position", "value", "cluster", (F.col("n") / F.col("total")).alias("share"))
    empty = [c for c in range(model.k) if c not in by_cluster]
    if empty:
        shares = written(shares.unionByName(model.shares.where(F.col("cluster").isin(empty))), "shares")
    return means, shares


def mixed_clusters(df: DataFrame, quali: list[str], quanti: list[str], **options) -> DataFrame:
    """Fit on the table and assign its rows: adds ``cluster`` and ``cluster_distance``."""
    return fit_mixed_clusters(df, quali, quanti, **options).assign(df)
