"""Order of the categories of wide columns, so that trees can split on them with a fixed number of bins.

A split of categories into two sets that explains a number best cuts them in the order of the number's means (Fisher, 1958);
for two classes it is the order of one class's shares, and for more classes the order along the first principal component
of the class shares is a good one (Coppersmith, Hong and Hosking, 1999). So each category is replaced by its mean: of the
label, or of its class's place on that component.

A row's own label must not reach its features. Rows are dealt to folds, and a category's mean for rows of a fold is taken
over the other folds, drawn towards the mean of all rows. A category that occurs once thus tells nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.columns import ref
from colscope.operators.lookup import look_up
from colscope.session import written

#: Parts that rows are dealt to, and rows' worth of the overall mean that is added to a category.
FOLDS, PRIOR_ROWS = 5, 10
#: Categories of a column, the most frequent ones, whose means are broadcast (``FOLDS`` rows each).
HOT_CATEGORIES = 1_000


def numbered(rows: DataFrame, name: str = "_row") -> DataFrame:
    """``rows`` with a number of its own for each, written to the shared folder: the fold of a row must not change
    when an executor is lost."""
    return written(rows.withColumn(name, F.monotonically_increasing_id()), "rows")


def _fold() -> Column:
    return F.pmod(F.xxhash64("_row"), F.lit(FOLDS)).cast("int")


def _long(rows: DataFrame, columns: list[str], ys: list[Column], *more: str) -> DataFrame:
    """``f, v, y`` rows: a column's position, its category (-1 when missing), and what is averaged for it."""
    parts = [F.struct(F.lit(i).alias("f"), F.coalesce(ref(c).cast("double"), F.lit(-1.0)).alias("v"), y.alias("y")) for i, (c, y) in enumerate(zip(columns, ys))]
    return rows.select(*more, F.inline(F.array(*parts)))


def class_places(rows: DataFrame, columns: list[str], label: str, classes: int) -> list[list[float]]:
    """For each column a number per class: the first principal component of its categories' class shares, in which a
    category weighs as many rows as it has. Only these numbers and the classes' shares reach the driver."""
    if classes <= 2:
        return [[0.0, 1.0]] * len(columns)
    counts = _long(rows, columns, [ref(label).cast("int")] * len(columns)).groupBy("f", "v", "y").agg(F.count(F.lit(1)).alias("n"))
    known = rows.groupBy(ref(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in known)
    shares = {r["y"]: r["n"] / total for r in known}
    vectors = counts.groupBy("f", "v").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("y", "n"))).alias("c"))
    # categories with the same counts, such as all that occur once with a class, are one vector of their joint weight
    vectors = vectors.groupBy("f", "n", "c").agg(F.count(F.lit(1)).alias("alike")).withColumn("c", F.map_from_entries("c"))
    centred = F.array(
        *[
            (F.coalesce(F.try_element_at("c", F.lit(k)), F.lit(0)) / F.col("n") - F.lit(shares.get(k, 0.0))) * F.sqrt(F.col("n") * F.col("alike"))
            for k in range(classes)
        ]
    )
    vectors = written(vectors.select("f", centred.alias("x")), "class-shares")
    out = []
    for i in range(len(columns)):
        mine = vectors.where(F.col("f") == i)
        # with each vector's negative the mean is zero, and the covariance is the weighted one of the shares
        both = mine.select(F.explode(F.array("x", F.transform("x", lambda a: -a))).alias("x"))
        model = PCA(k=1, inputCol="x", outputCol="place").fit(both.select(array_to_vector("x").alias("x")))
        out.append([float(a) for a in model.pc.toArray()[:, 0]])
    return out


def category_means(rows: DataFrame, columns: list[str], ys: list[Column]) -> tuple[DataFrame, list[float]]:
    """``f, v, fold, mean`` for each category and fold that has rows of it and others elsewhere, from one aggregate over all
    columns; and the mean of all rows for each column, which the others take."""
    long = _long(rows, columns, ys, "_row").withColumn("fold", _fold())
    sums = []
    for k in range(FOLDS):
        here = F.col("fold") == k
        sums += [F.count_if(here).alias(f"n{k}"), F.sum(F.when(here, F.col("y"))).alias(f"s{k}")]
    found = long.groupBy("f", "v").agg(*sums)
    n = reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in range(FOLDS)])
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(FOLDS)])
    found = found.select("f", "v", n.alias("n"), s.alias("s"), *[f"n{k}" for k in range(FOLDS)], *[F.coalesce(f"s{k}", F.lit(0.0)).alias(f"s{k}") for k in range(FOLDS)])
    # what occurs in one fold only, such as all of a column without repeats, need not be looked up
    found = written(found.where(F.greatest(*[F.col(f"n{k}") for k in range(FOLDS)]) < F.col("n")), "category-sums")
    # every row has a category in each column, if only that of the missing
    row = rows.agg(*[F.avg(y).alias(f"m{i}") for i, y in enumerate(ys)]).first()
    overall = [float(row[f"m{i}"] or 0.0) for i in range(len(columns))]
    prior = F.element_at(F.create_map(*[x for i, m in enumerate(overall) for x in (F.lit(i), F.lit(m))]), F.col("f"))
    folds = []
    for k in range(FOLDS):
        others = F.col("n") - F.col(f"n{k}")
        mean = (F.col("s") - F.col(f"s{k}") + prior * PRIOR_ROWS) / (others + PRIOR_ROWS)
        asked = (F.col(f"n{k}") > 0) & (others > 0)
        folds.append(F.when(asked, F.struct(F.lit(k).alias("fold"), mean.alias("mean"))))
    return found.select("f", "v", F.inline(F.array_compact(F.array(*folds)))), overall


def with_means(rows: DataFrame, columns: list[str], names: list[str], means: DataFrame, overall: list[float], sizes: list[int]) -> DataFrame:
    """``rows`` with the mean of each column's category for the row's fold, or the ``overall`` one, under ``names``.

    Columns without any mean of their own are not joined. Categories are numbered by frequency; at most ``HOT_CATEGORIES * FOLDS`` rows of means are broadcast (see ``look_up``).
    """
    out = rows.withColumn("_fold", _fold())
    known = {r["f"] for r in means.select("f").distinct().collect()}
    for i, (c, name, size) in enumerate(zip(columns, names, sizes)):
        if i not in known:
            out = out.withColumn(name, F.lit(overall[i]))
            continue
        mine = means.where(F.col("f") == i).select("v", "fold", F.col("mean").alias(name))
        keys = {"v": F.coalesce(ref(c).cast("double"), F.lit(-1.0)), "fold": F.col("_fold")}
        out = look_up(out, keys, mine, [name], size, HOT_CATEGORIES)
        out = out.withColumn(name, F.coalesce(ref(name), F.lit(overall[i])))
    return out.drop("_fold")


def ordered_categories(
    rows: DataFrame, columns: list[str], names: list[str], sizes: list[int], label: str, classes: int | None
) -> DataFrame:
    """``rows`` (numbered, with their label) and under ``names`` the place of each column's category in the order that
    suits the label: a class of ``classes`` ones, or a number when that is None."""
    if classes is None:
        ys = [ref(label).cast("double")] * len(columns)
    else:
        ys = [
            F.element_at(F.array(*[F.lit(p) for p in places]), ref(label).cast("int") + 1)
            for places in class_places(rows, columns, label, classes)
        ]
    return with_means(rows, columns, names, *category_means(rows, columns, ys), sizes)
