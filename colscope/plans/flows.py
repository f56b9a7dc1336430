"""The two analyses: which columns explain each other, and features and distances of mixed columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import dtype, is_term_array, is_time, ref, split_by_role
from colscope.constants import NULL_TERM, OTHER_TERM, TOP_TERMS
from colscope.functions.arrays import array_first_term, array_indicators, indicator_names
from colscope.functions.dates import date_bucketize
from colscope.functions.typing import cast_by_role, date_to_long
from colscope.operators.aggregates import terms_topk
from colscope.operators.encode import cap_terms, feature_stages, index_wide, string_index, without_nan
from colscope.operators.mixed import MixedDistance, mixed_distance
from colscope.operators.nulls import NullPlan, fill_by_role, fit_null_policy
from colscope.operators.relations import column_relations


def index_for_relations(
    df: DataFrame, entries: Mapping[str, Mapping], max_categories: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Cast text columns by role, bucket dates, fill and index; also names the encoded columns.

    All categories are kept. A caller who wants at most ``max_categories`` of them gets the leading ones,
    and the others become ``others``; missing values are ``null`` and count as a category.
    """
    typed = cast_by_role(df, entries)
    dated = date_bucketize(typed, [c for c in typed.columns if c.endswith("_date")])
    quali = [c for c in dated.columns if c.endswith("_quali")]
    quanti = [c for c in dated.columns if c.endswith("_quanti")]
    filled = fill_by_role(dated, quali, quanti)
    capped = cap_terms(filled, quali, max_categories - 1) if max_categories else {}
    if capped:
        filled = filled.select(
            *[
                F.when(ref(f.name).isin([*capped[f.name], NULL_TERM]), ref(f.name))
                .otherwise(F.lit(OTHER_TERM))
                .alias(f.name, metadata=f.metadata)
                if f.name in capped
                else ref(f.name)
                for f in filled.schema.fields
            ]
        )
    indexed = string_index(filled, quali, "_index") if quali else filled
    names = [c for c in indexed.columns if c.endswith(("_quali_index", "_quanti"))]
    return indexed, names


def analyse_relations(
    df: DataFrame,
    entries: Mapping[str, Mapping],
    labels: list[str] | None = None,
    max_categories: int | None = None,
    **params,
) -> DataFrame:
    """Importance of every column for every other one, from a table of text columns and its catalog."""
    indexed, names = index_for_relations(df, entries, max_categories)
    return column_relations(indexed, names, labels, **params)


@dataclass
class MixedFeatures:
    """Result of ``prepare_mixed``."""

    frame: DataFrame
    model: PipelineModel
    nulls: NullPlan
    quali: list[str]
    quanti: list[str]
    multi: list[str]
    left_out: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    with_terms: DataFrame | None = None
    lost_terms: DataFrame | None = None

    @property
    def index_columns(self) -> list[str]:
        return [f"{c}-index" for c in self.quali]

    @property
    def bin_columns(self) -> list[str]:
        return [f"{c}-bucketized" for c in self.quanti]

    def distances(self, multi: bool = False) -> MixedDistance:
        """Distances of the values of categories; with ``multi`` multi-valued columns take part with their terms."""
        if multi and self.with_terms is not None:
            return mixed_distance(self.with_terms, [*self.index_columns, *self.terms], self.bin_columns)
        return mixed_distance(self.frame, self.index_columns, self.bin_columns)


def unlisted_terms(df: DataFrame, listed: Mapping[str, list[str]]) -> DataFrame:
    """``column, terms, rows``: for each array column the distinct terms outside its list, and the rows that hold one."""
    parts = []
    for c, terms in listed.items():
        other = F.filter(F.array_distinct(F.array_compact(ref(c))), lambda t: ~t.isin(list(terms)) if terms else F.lit(True))
        parts.append(F.struct(F.lit(c).alias("column"), F.coalesce(other, F.array().cast("array<string>")).alias("other")))
    rows = df.select(F.inline(F.array(*parts)))
    held = rows.groupBy("column").agg(F.count_if(F.size("other") > 0).alias("rows"))
    found = rows.select("column", F.explode("other").alias("term")).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("terms"))
    return held.join(found, ["column"], "left").select("column", F.coalesce("terms", F.lit(0)).alias("terms"), "rows")


def prepare_mixed(
    df: DataFrame,
    entries: Mapping[str, Mapping] | None = None,
    terms: int = TOP_TERMS,
    keep: list[str] | None = None,
) -> MixedFeatures:
    """Clean and encode a typed table for distances and clustering.

    Null policy; array columns to one term, or to indicators where the catalog calls them multi-valued, whose listed
    terms ``distances`` can compare as ``<col>-terms``;
    timestamps to numbers; then indexes, one-hot slots, bins and the scaled feature vector. Columns the
    null policy drops take no further part, nor do columns the catalog calls ``other`` or ``coordinates``.
    Dates count as their midnight and booleans as text; ``left_out`` lists columns of any other type, and
    ``lost_terms`` counts the terms beyond the leading ``terms`` of each array column and the rows that hold them.
    ``keep`` names columns carried along unused.
    """
    entries = entries or {}
    keep = keep or []
    apart = [c for c in df.columns if c not in keep and entries.get(c, {}).get("type") in ("other", "coordinates")]
    df = df.drop(*apart)
    df = df.select(
        *[
            ref(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.DateType) and f.name not in keep
            else ref(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, T.BooleanType) and f.name not in keep
            else ref(f.name)
            for f in df.schema.fields
        ]
    )
    used = [c for c in df.columns if c not in keep]
    plan = fit_null_policy(df, used)
    work = plan.apply(df)
    used = [c for c in used if c not in plan.dropped]
    arrays = [c for c in used if is_term_array(dtype(work, c))]
    listed: dict[str, list[str]] = {c: [] for c in arrays}
    if arrays:
        for r in terms_topk(work, arrays, terms).select("field", "rank", "term").collect():
            listed[r["field"]].append((r["rank"], r["term"]))
    listed = {c: [t for _, t in sorted(v)] for c, v in listed.items()}
    lost = unlisted_terms(work, listed) if arrays else None
    quali = [c for c in split_by_role(work)["string"] if c in used]
    quanti = [c for c in split_by_role(work)["numeric"] if c in used]
    multi: list[str] = []
    held: list[str] = []
    for c in arrays:
        if entries.get(c, {}).get("is_multi"):
            work = array_indicators(work, c, listed[c])
            multi += indicator_names(c, listed[c])
            held.append(f"{c}-terms")
            listing = F.array(*[F.lit(t) for t in listed[c]]).cast("array<string>")
            work = work.select("*", F.array_intersect(ref(c), listing).alias(held[-1]))
        else:
            work = array_first_term(work, c, listed[c])
            quali.append(f"{c}-str")
    bounds = {
        c: (e["min"], e["max"])
        for c, e in entries.items()
        if c in quanti and e.get("min") is not None and e.get("max") is not None
    }
    for c in [c for c in used if is_time(dtype(work, c))]:
        out = f"{c}_int_index"
        work = date_to_long(work, c, out)
        quanti.append(out)
        e = entries.get(c, {})
        if e.get("min") is not None and e.get("max") is not None:
            bounds[out] = (e["min"], e["max"])
    left_out = [*apart, *[c for c in used if c not in quali and c not in quanti and c not in arrays and not is_time(dtype(work, c))]]
    work = without_nan(work, quanti)
    work, _, indexers = index_wide(work, quali)
    model = Pipeline(stages=feature_stages(work, quali, quanti, multi, bounds, indexers=indexers)).fit(work)
    names = [
        *keep, "features", *[f"{c}-index" for c in quali], *[f"{c}-bucketized" for c in quanti],
    ]
    encoded = model.transform(work)
    frame, with_terms = (encoded.select(*[ref(n) for n in some]) for some in (names, [*names, *held]))
    return MixedFeatures(frame, model, plan, quali, quanti, multi, left_out, held, with_terms, lost)
