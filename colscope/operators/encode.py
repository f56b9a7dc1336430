"""Encoding of columns for distances and forests: indexes, one-hot slots, bins, scaled vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Bucketizer,
    MinMaxScaler,
    OneHotEncoder,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.columns import counting_key, dtype, present, ref, require_new, require_present
from colscope.constants import DISTANCE_BINS, MAX_MODEL_LABELS
from colscope.operators.aggregates import field_terms, terms_topk, value_counts
from colscope.session import ensure_checkpointing, forget, scratch_path, written

# Labels per column small enough to broadcast when values are indexed by join.
HOT_LABELS = 1_000
# Metadata of an index whose labels are in a table: its path, beside the column's name there.
DICTIONARY = "dictionary"


class TooManyLabels(ValueError):
    """Columns with more labels than a driver-side model may hold."""

    def __init__(self, columns: list[str], most: int):
        super().__init__(f"more than {most} labels: {', '.join(columns)}; index them with index_by_join")
        self.columns = columns


def fit_string_index(
    df: DataFrame,
    columns: list[str],
    output_cols: list[str] | None = None,
    handle_invalid: str = "skip",
    max_labels: int = MAX_MODEL_LABELS,
) -> PipelineModel:
    """Fit the indexers of all columns in one job: most frequent label first, ties in label order.

    Nulls take no part in the fit. Labels are counted with an ordinary grouped aggregate; only the
    labels themselves reach the driver, never more than ``max_labels`` per column. For more labels use
    ``index_by_join``.
    """
    require_present(df, columns)
    outs = output_cols or [f"{c}-index" for c in columns]
    counts = field_terms(df, columns).groupBy("field", "term").agg(F.count("*").alias("count"))
    rows = counts.limit(max_labels * len(columns) + 1).collect()
    labels: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    for r in rows:
        labels[r["field"]].append((-r["count"], r["term"]))
    if len(rows) > max_labels * len(columns):
        sizes = {r["field"]: r["n"] for r in counts.groupBy("field").agg(F.count("*").alias("n")).collect()}
        raise TooManyLabels([c for c in columns if sizes.get(c, 0) > max_labels], max_labels)
    wide = [c for c, found in labels.items() if len(found) > max_labels]
    if wide:
        raise TooManyLabels(wide, max_labels)
    arrays = [[t for _, t in sorted(labels[c])] for c in columns]
    # one model per column: the multi-column constructor pads shorter label lists with nulls
    return PipelineModel(
        [
            StringIndexerModel.from_labels(a, inputCol=c, outputCol=o, handleInvalid=handle_invalid)
            for a, c, o in zip(arrays, columns, outs)
        ]
    )


def string_index(
    df: DataFrame,
    columns: list[str],
    suffix: str = "-index",
    handle_invalid: str = "skip",
    max_labels: int = MAX_MODEL_LABELS,
) -> DataFrame:
    """Add ``<col><suffix>`` with the frequency rank of the value; rows with nulls follow
    ``handle_invalid`` (``skip`` drops them, ``keep`` gives them an index of their own).

    Columns with more than ``max_labels`` labels get the same numbers by ``index_by_join``.
    """
    outs = [c + suffix for c in columns]
    require_new(df, outs)
    try:
        return fit_string_index(df, columns, outs, handle_invalid, max_labels).transform(df)
    except TooManyLabels as found:
        wide = found.columns
    narrow = [c for c in columns if c not in wide]
    # ranks are those of the whole table, so rows without a value go last
    models = fit_string_index(df, narrow, [c + suffix for c in narrow], handle_invalid, max_labels) if narrow else None
    out = index_by_join(df, wide, suffix, handle_invalid)
    out = models.transform(out) if models else out
    return out.select(*[ref(c) for c in df.columns], *[ref(o) for o in outs])


def index_wide(df: DataFrame, columns: list[str], max_labels: int = MAX_MODEL_LABELS) -> tuple[DataFrame, list[str], PipelineModel | None]:
    """For a pipeline: columns with too many labels for a stage indexed by join, their names, and the
    fitted indexers of the others."""
    outs = lambda some: [f"{c}-index" for c in some]
    try:
        return df, [], fit_string_index(df, columns, outs(columns), "skip", max_labels) if columns else None
    except TooManyLabels as found:
        wide = found.columns
    narrow = [c for c in columns if c not in wide]
    models = fit_string_index(df, narrow, outs(narrow), "skip", max_labels) if narrow else None
    return index_by_join(df, wide, "-index", "skip"), wide, models


def index_labels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Labels of encoded columns: ``column, label, index``.

    They are read from the columns' metadata, or from the dictionary that metadata name, which holds any number of
    labels and is there until the application ends. Columns are all with either, unless named.
    """
    attrs = {f.name: f.metadata.get("ml_attr", {}) for f in df.schema.fields}
    cols = columns or [c for c, a in attrs.items() if "vals" in a or DICTIONARY in a]
    bare = [c for c in cols if "vals" not in attrs[c] and DICTIONARY not in attrs[c]]
    if bare:
        raise ValueError(f"column {bare[0]} carries no labels")
    spark = df.sparkSession
    rows = [(c, v, float(i)) for c in cols for i, v in enumerate(attrs[c].get("vals", []))]
    out = spark.createDataFrame(rows, "column string, label string, index double")
    for c in [c for c in cols if "vals" not in attrs[c]]:
        found = spark.read.parquet(attrs[c][DICTIONARY]).where(F.col("column") == attrs[c]["dictionary_column"])
        out = out.unionByName(found.select(F.lit(c).alias("column"), "label", "index"))
    return out


def rank_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, label, index`` for any number of labels, without gathering a column in one task.

    Labels are range-partitioned and sorted by (column, descending count, label); a label's index is its place in
    its partition plus the sizes of the partitions before it. Partition and place are written to the shared folder
    with the rows, so a lost executor cannot make two reads disagree about them.
    """
    return _indexed(_placed(df, columns))


def _placed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, label, count, at``: counted labels, written once; ``at`` numbers a partition's one after the other."""
    counts = value_counts(df, columns).select(
        "column", F.col("value").cast("string").alias("label"), "count"
    )
    order = [F.col("column").asc(), F.col("count").desc(), F.col("label").asc()]
    return written(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "places")


def _indexed(placed: DataFrame) -> DataFrame:
    """``column, label, index, count`` of ``_placed`` labels. They are not shuffled again."""
    # the number of a partition is above those of its rows
    placed = placed.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (column, partition): bounded by the number of columns times shuffle partitions
    offsets = placed.groupBy("column", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    offsets = offsets.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first"))
    return placed.join(F.broadcast(offsets.select("column", "part", "start")), ["column", "part"]).select(
        "column", "label", (F.col("start") + F.col("at")).cast("double").alias("index"), "count"
    )


def index_by_join(
    df: DataFrame, columns: list[str], suffix: str = "-index", handle_invalid: str = "null"
) -> DataFrame:
    """``string_index`` for columns with any number of labels; by default null stays null.

    Labels are ranked once and stored. The most frequent of each column, at most ``HOT_LABELS``, or all of up to ten times as many, are
    broadcast under keys of at most 65 characters, so the rows that hold them are not moved to a task of
    their own label; only a column with more labels joins the rest by shuffle, where rows already
    served are spread evenly instead of meeting in one null partition. The labels are written to the shared
    folder; metadata keep their number and where they are, for ``index_labels``.
    """
    require_new(df, [c + suffix for c in columns])
    ensure_checkpointing(df.sparkSession)
    at = scratch_path(df.sparkSession, "labels")
    placed = _placed(df, columns)
    _indexed(placed).select("column", "label", "index").write.parquet(at)
    forget(placed)
    labels = df.sparkSession.read.parquet(at).select("column", counting_key(F.col("label")).alias("label"), "index")
    sizes = {r["column"]: r["n"] for r in labels.groupBy("column").agg(F.count("*").alias("n")).collect()}
    kept = [ref(c) for c in df.columns]
    out = df
    for c in columns:
        size = sizes.get(c, 0)
        mine = labels.where(F.col("column") == c)
        leading = size if size <= 10 * HOT_LABELS else HOT_LABELS
        hot = mine.where(F.col("index") < leading).select(
            F.col("label").alias("_hot"), F.col("index").alias("_hot_index")
        )
        out = out.withColumn("_key", counting_key(ref(c).cast("string")))
        out = out.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
        done = F.col("_hot_index")
        if size > leading:
            cold = mine.where(F.col("index") >= leading).select(
                F.col("label").alias("_cold"), F.col("index").alias("_cold_index"), F.lit(0).alias("_slot")
            )
            unserved = F.col("_hot").isNull() & F.col("_key").isNotNull()
            # by partition number and label: a retried task places its rows as before
            spread = F.pmod(F.xxhash64(F.spark_partition_id(), F.col("_key")), F.lit(4096)).cast("int")
            out = out.withColumn("_row_slot", F.when(unserved, F.lit(0)).otherwise(spread + 1))
            match = (F.col("_key") == F.col("_cold")) & (F.col("_row_slot") == F.col("_slot"))
            out = out.join(cold, match, "left")
            done = F.coalesce("_hot_index", "_cold_index")
        if handle_invalid == "keep":
            done, size = F.coalesce(done, F.lit(float(size))), size + 1
        elif handle_invalid == "skip":
            out = out.where(done.isNotNull())
        meta = {"ml_attr": {"type": "nominal", "name": c + suffix, "num_vals": size, DICTIONARY: at, "dictionary_column": c}}
        out = out.select(*kept, done.alias(c + suffix, metadata=meta))
        kept.append(ref(c + suffix))
    return out


def one_hot(df: DataFrame, columns: list[str], output_cols: list[str] | None = None) -> DataFrame:
    """Add a vector per indexed column, one slot per label and none left out."""
    outs = output_cols or [f"{c}-vec" for c in columns]
    require_new(df, outs)
    return OneHotEncoder(inputCols=columns, outputCols=outs, dropLast=False).fit(df).transform(df)


def equal_splits(lo: float | None, hi: float | None, bins: int = DISTANCE_BINS) -> list[float]:
    """Edges of ``bins`` equal-width bins, open at both ends; a constant column gets a single bin."""
    if lo is None or hi is None:
        raise ValueError("smallest or largest value is not defined")
    lo, hi = float(lo), float(hi)
    if lo > hi:
        raise ValueError(f"smallest value {lo} exceeds largest value {hi}")
    step = (hi - lo) / bins
    inner = [lo + step * i for i in range(1, bins)]
    # values so close together that edges coincide share a bin
    inner = [e for i, e in enumerate(inner) if lo < e < hi and (i == 0 or e > inner[i - 1])]
    return [float("-inf"), *(inner or [hi]), float("inf")] if lo < hi else [float("-inf"), float("inf")]


def bucketizer(
    bounds: Mapping[str, tuple[float, float]], suffix: str = "-bucketized", bins: int = DISTANCE_BINS
) -> list[Bucketizer]:
    """Bucketizer stages for columns with known bounds.

    Columns with a single bin are kept apart: the stage wants at least three edges, and two infinite
    edges with one in between that no value exceeds give bin 0 for every row.
    """
    cols = list(bounds)
    splits = []
    for c in cols:
        s = equal_splits(*bounds[c], bins)
        splits.append(s if len(s) > 2 else [float("-inf"), float("1.7976931348623157e308"), float("inf")])
    return [
        Bucketizer(splitsArray=splits, inputCols=cols, outputCols=[c + suffix for c in cols], handleInvalid="keep")
    ] if cols else []


def numeric_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column, in one aggregate (one row reaches the driver)."""
    require_present(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        v = F.nanvl(ref(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def bucketize(
    df: DataFrame,
    columns: list[str],
    bounds: Mapping[str, tuple[float, float]] | None = None,
    bins: int = DISTANCE_BINS,
) -> DataFrame:
    """Add ``<col>-bucketized`` with the bin number. Bounds come from a catalog, else from the table."""
    require_new(df, [f"{c}-bucketized" for c in columns])
    bounds = bounds or numeric_bounds(df, columns)
    missing = [c for c in columns if c not in bounds or None in bounds[c]]
    if missing:
        raise ValueError(f"no bounds for {', '.join(missing)}")
    # a missing number is no bin, whether it came as null or as NaN
    shown = {c: f"_present_{i}" for i, c in enumerate(columns)}
    out = df.select("*", *[present(ref(c), dtype(df, c)).alias(n) for c, n in shown.items()])
    for stage in bucketizer({c: bounds[c] for c in columns}, bins=bins):
        out = stage.setInputCols([shown[c] for c in columns]).transform(out)
    return out.drop(*shown.values())


def assemble(df: DataFrame, columns: list[str], output_col: str = "features") -> DataFrame:
    """Add one vector of the given columns; missing numbers become NaN slots."""
    require_new(df, [output_col])
    return VectorAssembler(inputCols=columns, outputCol=output_col, handleInvalid="keep").transform(df)


def minmax_scale(df: DataFrame, vector_col: str, output_col: str) -> DataFrame:
    """Scale every slot to 0..1 by its smallest and largest value; a constant slot gives 0.5."""
    require_new(df, [output_col])
    return MinMaxScaler(inputCol=vector_col, outputCol=output_col).fit(df).transform(df)


def slots(df: DataFrame, vector_col: str, *keep: str | Column) -> DataFrame:
    """Vector as rows ``slot, value`` next to the kept columns."""
    return df.select(*keep, F.posexplode(vector_to_array(ref(vector_col))).alias("slot", "value"))


def feature_stages(
    df: DataFrame,
    quali: list[str],
    quanti: list[str],
    multi: list[str],
    bounds: Mapping[str, tuple[float, float]] | None = None,
    output_col: str = "features",
    indexers: PipelineModel | None = None,
) -> list:
    """Stages turning cleaned columns into the feature vector, indexes and bins (see
    ``prepare_features``). Labels and bounds are found here, once for all columns; ``indexers`` are
    those of the qualitative columns that ``df`` holds no index of yet."""
    stages: list = []
    parts: list[str] = []
    if quali:
        index = [f"{c}-index" for c in quali]
        vectors = [f"{c}-vec" for c in quali]
        todo = [c for c in quali if f"{c}-index" not in df.columns]
        if todo:
            stages.append(indexers or fit_string_index(df, todo, [f"{c}-index" for c in todo], "skip"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=vectors, dropLast=False))
        parts += vectors
    if quanti:
        known = dict(bounds or {})
        missing = [c for c in quanti if c not in known or None in known[c]]
        if missing:
            known |= numeric_bounds(df, missing)
        empty = [c for c in quanti if None in known[c]]
        if empty:
            raise ValueError(f"no bounds for {', '.join(empty)}")
        stages += bucketizer({c: known[c] for c in quanti})
        stages.append(VectorAssembler(inputCols=quanti, outputCol="numericFeatures", handleInvalid="keep"))
        stages.append(MinMaxScaler(inputCol="numericFeatures", outputCol="scaledNumericFeatures"))
        parts.append("scaledNumericFeatures")
    if multi:
        stages.append(
            VectorAssembler(inputCols=multi, outputCol="multiQualiFeatures", handleInvalid="keep")
        )
        parts.append("multiQualiFeatures")
    if not parts:
        raise ValueError("no columns to encode")
    stages.append(VectorAssembler(inputCols=parts, outputCol=output_col, handleInvalid="keep"))
    return stages


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers as nulls in the given columns."""
    return df.select(
        *[
            present(ref(f.name), f.dataType).alias(f.name, metadata=f.metadata) if f.name in columns else ref(f.name)
            for f in df.schema.fields
        ]
    )


def prepare_features(
    df: DataFrame,
    quali: list[str],
    quanti: list[str],
    multi: list[str] | None = None,
    bounds: Mapping[str, tuple[float, float]] | None = None,
    keep: list[str] | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """Feature vector plus every index and bin column, and the fitted pipeline.

    The vector holds the one-hot slots of the qualitative columns, the scaled numbers, then the
    indicators of the multi-valued columns. Bounds missing from ``bounds`` are measured on the table.
    """
    multi = multi or []
    df = without_nan(df, quanti)
    df, _, indexers = index_wide(df, quali)
    model = Pipeline(stages=feature_stages(df, quali, quanti, multi, bounds, indexers=indexers)).fit(df)
    out = model.transform(df)
    names = [
        *(keep or []), "features",
        *[f"{c}-index" for c in quali],
        *[f"{c}-bucketized" for c in quanti],
    ]
    return out.select(*[ref(n) for n in names]), model


def cap_terms(df: DataFrame, columns: list[str], size: int) -> dict[str, list[str]]:
    """Leading terms of the columns that have more than ``size`` of them; the rest are left alone."""
    if not columns:
        return {}
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in terms_topk(df, columns, size + 1).select("field", "rank", "term").collect():
        found[r["field"]].append((r["rank"], r["term"]))
    return {
        c: [t for _, t in sorted(terms)[:size]] for c, terms in found.items() if len(terms) > size
    }
