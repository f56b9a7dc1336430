"""Exact top-k search by vector approximations.

Vectors become integers (``floor(scale * x)``) and are packed into blocks. A block keeps, beside its exact
rows in the table, one byte for each component: the cell of a grid that fits the block. A scan of the cells
bounds every inner product from below and above. A vector whose upper bound is under the kth best lower bound
is out; of the rest, exact vectors are read in order of their upper bounds (which is lower-bound order of
distances): first k for each query, then those that the kth exact score of these leaves open.

Queries meet candidates in blocks: a group of candidate blocks and a block of queries share a task, so
neither side is sent whole anywhere. Of equal vectors only the k + 1 rows of smallest ids can be among the best k, so
only these are candidates. Components are whole up to 2**55 and held there beyond; scores are summed and ranked
exactly, and returned as at most 64 bits hold. Bounds that doubles cannot hold exactly are widened by their rounding.

Defined cases: a null vector, or one with a null or non-finite component, takes no part; a row without an id
takes no part; a vector is compared with vectors of its own length only; rows that share an id are
rows of their own, as queries and as candidates (of each other too); fewer than k candidates give fewer rows; no vectors give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.scratch import stored

BLOCK_ROWS = 2048
#: Candidate blocks that one task meets with one block of queries.
GROUP_BLOCKS = 8
#: Query rows by candidates that a task bounds at once.
PRODUCT_CELLS = 1 << 22
_LIMIT = 2**55


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v, top): rows that take part, as arrays of longs, and their greatest component in size."""
    x = F.col(vector)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    clip = lambda v: F.least(F.greatest(F.floor(F.lit(float(scale)) * F.least(F.greatest(v.cast("double"), F.lit(-1e17)), F.lit(1e17))), F.lit(-_LIMIT)), F.lit(_LIMIT)).cast("long")
    whole = df.filter(F.col(key).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, clip).alias("v"))
    return whole.withColumn("top", F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)))


def _packed(rows: pa.Table, exact: bool) -> Iterator[dict]:
    """Blocks of one partition's vectors, by their length."""
    ids = rows.column("rid").to_numpy()
    col = rows.column("v").combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        of = np.flatnonzero(sizes == d)
        for k in range(0, len(of), BLOCK_ROWS):
            part = of[k : k + BLOCK_ROWS]
            m = flat[at[part][:, None] + np.arange(d)].astype(np.int64).reshape(len(part), d)
            row = {"d": int(d), "n": len(part), "ids": ids[part].astype(np.int64).tobytes()}
            if exact:
                yield row | {"exact": m.tobytes()}
            else:
                low = m.min(axis=0) if d else np.zeros(0, np.int64)
                width = (m.max(axis=0) - low) // 256 + 1 if d else low
                yield row | {"low": low.tobytes(), "width": width.tobytes(), "cells": ((m - low) // width).astype(np.uint8).tobytes()}


def _pack(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            rows = list(_packed(pa.Table.from_batches(held), exact))
            return pa.RecordBatch.from_pylist(rows, schema=_EXACT if exact else _CELLS)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


_CELLS = pa.schema([("d", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("width", pa.binary()), ("cells", pa.binary())])
_EXACT = pa.schema([("d", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("exact", pa.binary())])


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of whole rows in doubles, and how far from exact they can be."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return a.astype(np.float64) @ b.astype(np.float64).T, 0.0 if most < 2**53 else most * (a.shape[1] + 4) * 2.0**-52


def _bounded(k: int):
    def run(key: tuple, cells: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        size = int(cells["n"].sum())
        for q in queries.itertuples():
            d, step = q.d, max(1, PRODUCT_CELLS // max(1, size))
            for at in range(0, q.n if size else 0, step):
                qid = np.frombuffer(q.ids, np.int64)[at : at + step]
                qv = np.frombuffer(q.exact, np.int64).reshape(q.n, d)[at : at + step]
                up, down = np.maximum(qv, 0), np.minimum(qv, 0)
                lows, ups, ids = [], [], []
                for c in cells.itertuples():
                    low, width = np.frombuffer(c.low, np.int64), np.frombuffer(c.width, np.int64)
                    base = low + np.frombuffer(c.cells, np.uint8).reshape(c.n, d).astype(np.int64) * width
                    (middle, off), (less, _), (more, off2) = _product(qv, base), _product(down, width[None] - 1), _product(up, width[None] - 1)
                    lows.append(middle + less - 2 * (off + off2))
                    ups.append(middle + more + 2 * (off + off2))
                    ids.append(np.frombuffer(c.ids, np.int64))
                lows, ups, ids = np.hstack(lows), np.hstack(ups), np.concatenate(ids)
                own = qid[:, None] == ids[None, :]
                lows[own] = -np.inf
                kth = np.partition(lows, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qid), -np.inf)
                i, j = np.nonzero((ups >= kth[:, None]) & ~own)
                parts.append(pd.DataFrame({"query": qid[i], "rid": ids[j], "low": lows[i, j], "up": ups[i, j]}))
        if parts:
            return pd.concat(parts)
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query", "int64"), ("rid", "int64"), ("low", "float64"), ("up", "float64"))})

    return run


def _score(x: Column, y: Column, most: Column) -> Column:
    """Inner product of arrays of longs as a decimal, summed in 64 bits where it can't pass them."""
    plain = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda t, v: t + v)
    wide = lambda a: a.cast("decimal(18,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    exact = F.aggregate(F.zip_with(x, y, lambda a, b: (wide(a) * wide(b)).cast("decimal(38,0)")), zero, lambda t, v: (t + v).cast("decimal(38,0)"))
    return F.when(most < 2.0**62, plain.cast("decimal(38,0)")).otherwise(exact)


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``is_query`` its ``k`` best other rows,
    by inner product, ties to the smaller id. ``is_query`` is a condition on vec_id."""
    vectors = stored(integer_vectors(df, key, vector, scale).withColumn("rid", F.monotonically_increasing_id()), "va-vectors")
    alike = Window.partitionBy("v").orderBy("vec_id", "rid")
    candidates = vectors.withColumn("_place", F.row_number().over(alike)).filter(F.col("_place") <= k + 1).drop("_place")
    asked = vectors.filter(is_query)
    q = stored(asked.select("rid", "v").repartition("rid").mapInArrow(_pack(True), "d int, n int, ids binary, exact binary").withColumn("qb", F.monotonically_increasing_id()), "va-queries")
    c = stored(candidates.select("rid", "v").mapInArrow(_pack(False), "d int, n int, ids binary, low binary, width binary, cells binary").withColumn("cb", F.monotonically_increasing_id()), "va-cells")
    groups = max(1, -(-c.count() // GROUP_BLOCKS))
    c = c.withColumn("g", F.pmod(F.xxhash64("cb"), F.lit(groups)).cast("int"))
    # every block of queries goes to every group of candidate blocks, and to no other place
    names = q.select(F.col("qb").alias("for_qb"), F.col("d").alias("qd"))
    left = c.join(names, F.col("d") == F.col("qd")).groupBy("for_qb", "g")
    right = q.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("qb", "g")
    found = left.cogroup(right).applyInPandas(_bounded(k), "query long, rid long, low double, up double")
    found = stored(found, "va-bounds")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"))
    by_up = Window.partitionBy("query").orderBy(F.desc("up"), "rid")
    kth = found.withColumn("r", F.row_number().over(by_low)).filter(F.col("r") == k).select("query", F.col("low").alias("kth"))
    open_ = found.join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("up") >= F.col("kth"))).withColumn("n", F.row_number().over(by_up))
    open_ = stored(open_.select("query", "rid", "up", "n"), "va-open")

    def exact(pairs: DataFrame) -> DataFrame:
        a = asked.select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("_q"), F.col("top").alias("_most"))
        b = vectors.select("rid", "vec_id", F.col("v").alias("_c"), "top")
        same = pairs.select("query", "rid").join(a, "query").join(b, "rid")
        most = F.col("_most").cast("double") * F.col("top") * F.size("_q")
        return same.select("query", "query_id", "rid", "vec_id", _score(F.col("_q"), F.col("_c"), most).alias("score"))

    first = stored(exact(open_.filter(F.col("n") <= k)), "va-exact")
    certain = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("read"))
    later = open_.filter(F.col("n") > k).join(certain, "query").filter((F.col("read") < k) | (F.col("up") >= F.col("least")))
    scores = first.unionByName(exact(later))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    least, most = (F.lit(str(v)).cast("decimal(38,0)") for v in (-(2**63), 2**63 - 1))
    return ranked.select("query_id", "rank", "vec_id", F.greatest(F.least("score", most), least).cast("long").alias("score"))
