"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of whole texts are standardised and mapped to cosines whose products approximate a Gaussian kernel.
Partitions sum their share of the normal equations; the sums, of a fixed size, are solved on the driver.
Isotonic regression over fixed bins of the fitted scores turns them into probabilities.

Labels are learned from rows that are not held out, at most ``SAMPLE_ROWS`` of them, chosen by a hash of their id.

Defined cases: a null text counts as empty and has a score as any other; labels that are null are left out, and
of several labels for one id their mean counts; without usable labels every score is 0.5, and with
one class only it is that class. Rows without an id are not held out and teach nothing. Repeated rows are scored each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.llm.scratch import stored
from colscope.llm.words import shingles, steps, text_bytes, words

#: Labelled rows that are learned from, about.
SAMPLE_ROWS = 400_000
#: Partitions that sum normal equations.
SUM_PARTITIONS = 16
COSINES = 256
KERNEL_WIDTH = 3.0
RIDGE = 1e-3
BINS = 512
THRESHOLD = 0.7
SEED = 20

NAMES = [
    "log_words", "word_length", "word_length_spread", "symbols", "capitals", "digits", "marks", "shouts", "beyond_ascii", "duplicate_lines", "log_line", "repeated", "distinct",
    "stutter", "wordless", "common", "vowels", "odd_ends", "short", "long",
]


def _set(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOLS, _DIGITS, _MARKS, _VOWELS = _set("#*$%&|<>{}[]\\^~_=+@"), _set("0123456789"), _set(".,;:?'\"()-"), _set("aeiouyAEIOUY")
_UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _set("abcdefghijklmnopqrstuvwxyz")
_LINE = ~_set("\n")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _again(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where an equal key stands in an earlier place of the same row."""
    order = np.lexsort((keys, row))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    data, ends = text_bytes(texts)
    w = words(texts)
    n = w.count.astype(float)
    some = np.maximum(n, 1)
    h, row = w.hashes(False), w.row
    size = (w.end - w.start).astype(float)
    byte = lambda t: _sums(t[data], ends)
    chars = np.maximum(np.diff(ends), 1)
    letters = np.maximum(byte(_LETTER), 1)
    mean = _sums(size, w.first) / some
    lines = words(texts, ~_LINE)
    line_n = np.maximum(lines.count, 1)
    line_h = lines.hashes(False)
    s, at = shingles(w, h, 3)
    keys, inverse, counts = np.unique(s ^ (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    covered = np.zeros(len(h) + 3, bool)
    for k in range(3):
        covered[twice + k] = True
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(len(n))
    if len(starts):
        np.maximum.at(most, row[order][starts], np.diff(np.append(starts, len(h))).astype(float))
    distinct = _sums(new.astype(float), np.searchsorted(row[order], np.arange(len(n) + 1)))
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last = data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    letter_sum = np.concatenate([[0], np.cumsum(_LETTER[data] | (data >= 128))])
    no_letter = letter_sum[w.end] == letter_sum[w.start]
    per_word = lambda x: _sums(x, w.first) / some
    return np.column_stack([
        np.log1p(n), mean, np.sqrt(np.maximum(per_word(size * size) - mean**2, 0)), byte(_SYMBOLS) / some, byte(_UPPER) / letters, byte(_DIGITS) / chars, byte(_MARKS) / some,
        byte(_set("!")) / some, byte(np.arange(256) >= 128) / chars, _sums(_again(line_h, lines.row), lines.first) / line_n, np.log1p(chars / line_n), per_word(covered[: len(h)]),
        distinct / some, per_word(stutter), per_word(no_letter), most / some, byte(_VOWELS) / letters, per_word(_SYMBOLS[last]), per_word(size <= 2), per_word(size > 14),
    ])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``f``, the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            x = statistics(b.column("text"))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.ListArray.from_arrays(at, pa.array(x.ravel()))], [*keep, "f"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("f", T.ArrayType(T.DoubleType()))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


@dataclass
class Model:
    """Scores statistics; all arrays are of a fixed size."""

    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.ones(len(z)), z, np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means of ordered groups, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for s, c in zip(sums, counts):
        pools.append([float(s), float(c), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a)]
    return np.repeat([s / c for s, c, _ in pools], [int(k) for _, _, k in pools])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, len(NAMES)))


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of (doc_id, f, y); None without rows."""
    total = rows.count()
    if not total:
        return None
    share = min(1.0, sample_rows / total)
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("f", "y")
    rows = stored(rows.repartition(SUM_PARTITIONS), "quality-rows")
    width = len(NAMES)
    figures = rows.agg(*[F.avg(F.get("f", k)).alias(f"m{k}") for k in range(width)], *[F.stddev_pop(F.get("f", k)).alias(f"s{k}") for k in range(width)]).first()
    if figures[0] is None:
        return None
    rng = np.random.default_rng(SEED)
    spread = np.array([figures[width + k] for k in range(width)])
    turn = rng.normal(size=(width, COSINES)) / KERNEL_WIDTH
    model = Model(np.array([figures[k] for k in range(width)]), np.where(spread > 1e-9, spread, 1.0), turn, rng.uniform(0, 2 * np.pi, COSINES), np.zeros(0), np.zeros(0), np.zeros(0))
    d = 1 + width + COSINES

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for p in parts:
            m = model.mapped(_matrix(p["f"]))
            a += m.T @ m
            b += m.T @ p["y"].to_numpy()
        yield pd.DataFrame({"i": np.arange(d), "v": list(np.column_stack([a, b]))})

    added = rows.mapInPandas(sums, "i int, v array<double>")
    added = added.groupBy("i").applyInPandas(lambda g: pd.DataFrame({"i": [g["i"].iloc[0]], "v": [np.vstack(g["v"].to_numpy()).sum(axis=0)]}), "i int, v array<double>")
    ab = np.vstack([r["v"] for r in sorted(added.collect(), key=lambda r: r["i"])])
    a, b = ab[:, :d], ab[:, d]
    n = a[0, 0]
    model.weight = np.linalg.solve(a / n + RIDGE * np.diag([1e-6] + [1.0] * (d - 1)), b / n)

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            r = model.raw(_matrix(p["f"]))
            yield pd.DataFrame({"bin": np.floor((np.clip(r, -0.5, 1.5) + 0.5) / 2 * BINS).astype("int32"), "r": r, "y": p["y"]})

    bins = rows.mapInPandas(scored, "bin int, r double, y double").groupBy("bin").agg(F.avg("r").alias("r"), F.sum("y").alias("s"), F.count(F.lit(1)).alias("c"))
    bins = bins.orderBy("bin").toPandas()
    model.knots, model.values = bins["r"].to_numpy(), isotonic(bins["s"].to_numpy(), bins["c"].to_numpy())
    return model


def labelled(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, f, y): rows of (doc_id, f) that are not held out and have a label."""
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
    return rows.filter(~held_out(F.col("doc_id"))).join(y, "doc_id").select("doc_id", "f", "y")


def _scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else model.score(x)


def score_features(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` with f replaced by ``score`` and ``predicted``."""
    keep = [c for c in rows.columns if c not in ("f", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(model, b.column("f").flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s)], [*keep, "score"])

    schema = T.StructType([rows.schema[c] for c in keep]).add("score", T.DoubleType())
    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            s = _scores(model, statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s)], [*keep, "score"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("score", T.DoubleType())
    return docs.select(*keep).mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = stored(features(docs, ["doc_id"]), "quality-features")
    model = fit(labelled(rows, labels, label))
    return score_features(rows.withColumn("held_out", held_out(F.col("doc_id"))), model)
