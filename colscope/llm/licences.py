"""License scans: a trained paragraph classifier, calibrated, and confirmed by template comparison.

Paragraphs (lines, long ones in overlapping windows) are bags of word 1- to 3-grams. A multinomial logistic
regression over the n-grams that licence notices are made of tells licence families and ``unknown`` apart. It is
trained here, on damaged copies of the notices below and on paragraphs of the corpus, at most about
``SAMPLE_DOCS`` documents, with shuffled notice words as harder strangers. The probability of not being unknown is
calibrated by isotonic regression on a part kept aside. A prediction counts if a notice of its family has
``AGREEMENT`` of its n-grams in the paragraph.

A notice may also be broken over lines, and a line may hold several: runs of lines between blank lines are searched
for stretches about a notice long that agree with it, and each such stretch is classified by itself. A
mention's line is the one it begins in.

Defined cases: a null or empty text has no paragraphs and no licence; each mention is found, repeated rows
too; whole texts are read; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.quality import isotonic
from colscope.llm.words import Words, mix, steps, words

WINDOW_WORDS = 96
AGREEMENT = 0.7
SAMPLE_DOCS = 1_000
SAMPLE_WINDOWS = 4_000
COPIES = 60
THRESHOLD = 0.5
UNKNOWN = "unknown"
SEED = 8

# Short notices as the licences' own texts word them.
NOTICES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
    ],
    "all_rights_reserved": ["all rights reserved"],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache license version 2 0",
    ],
    "bsd": [
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd 3 clause license",
        "bsd 2 clause license",
    ],
    "cc_by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license", "cc by nc sa 4 0", "cc by nc nd 4 0"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license"],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "public_domain": ["this work is in the public domain", "cc0 1 0 universal public domain dedication", "this is free and unencumbered software released into the public domain"],
}

_APART = np.ones(256, bool)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def grams(w: Words, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 1- to 3-grams that lie in one line, and the word each begins at."""
    h = w.hashes(True)
    parts, at, key = [], [], np.zeros(len(h), np.uint64)
    for n in (1, 2, 3):
        m = len(h) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(0x9FB21C651E98DF25) + h[n - 1 :]
        ok = np.flatnonzero(line[:m] == line[n - 1 :])
        parts.append(mix(key[ok] + np.uint64(n)))
        at.append(ok)
    return (np.concatenate(parts), np.concatenate(at)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def stretches(places: np.ndarray, k: np.ndarray, notice: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(n-grams of the notice, first and last word) of stretches that hold ``AGREEMENT`` of them, best first, none
    overlapping; an n-gram ``k`` begins at the word ``places``, which ascend."""
    use = np.isin(k, notice)
    p, k = places[use].tolist(), k[use].tolist()
    reach, able = length + max(2, length // 4), []
    for i in range(len(p)):
        held, last = set(), i
        for j in range(i, len(p)):
            if p[j] >= p[i] + reach:
                break
            if k[j] not in held:
                held.add(k[j])
                last = j
        if len(held) >= AGREEMENT * len(notice):
            able.append((len(held), p[i] - p[last], p[i], p[last]))
    found, covered = [], set()
    for n, _, first, last in sorted(able, key=lambda s: (-s[0], -s[1], s[2])):
        if covered.isdisjoint(range(first, last + 1)):
            covered.update(range(first, last + 1))
            found.append((n, first, last))
    return found


def mentions(texts: pa.Array, model: "Model", sieve: np.ndarray) -> list[tuple[int, int, int, int, float, float]]:
    """(row, first and last line, family, probability, agreement) of the stretches of paragraphs that are notices."""
    w = words(texts, _APART)
    if not len(w.start):
        return []
    row = w.row
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    # a line with nothing but white space ends a paragraph
    dense = np.concatenate([[0], np.cumsum(~_BLANK[w.data])])
    ends = np.flatnonzero(w.data == 10)
    blank = ends[1:][dense[ends[1:]] == dense[ends[:-1] + 1]]
    part = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(np.searchsorted(blank, w.start)) > 0)])) - 1
    g, at = grams(w, part)
    use = sieve[(g >> np.uint64(48)).astype(np.int64)]
    g, at = g[use], at[use]
    k = np.minimum(np.searchsorted(model.known, g), len(model.known) - 1)
    ok = model.known[k] == g
    k, at = k[ok], at[ok]
    order = np.argsort(at, kind="stable")
    k, at = k[order], at[order]
    of = part[at]
    pair = np.unique(of * len(model.known) + k)
    pair_part, pair_gram = pair // len(model.known), pair % len(model.known)
    tried: dict[int, list] = {}
    for notices in model.notices:
        for t in notices:
            hits = np.bincount(pair_part[np.isin(pair_gram, t)], minlength=1)
            for x in np.flatnonzero(hits >= AGREEMENT * len(t)).tolist():
                a, b = np.searchsorted(of, (x, x + 1))
                length = (len(t) + 3) // 3  # words, if no n-gram is repeated
                tried.setdefault(x, []).extend(stretches(at[a:b], k[a:b], t, length))
    out = []
    for found in tried.values():
        taken: set[int] = set()
        for _, first, last in sorted(set(found), key=lambda s: (-s[0], s[1], s[2])):
            if not taken.isdisjoint(range(first, last + 1)):
                continue
            a, b = np.searchsorted(at, (first, last + 1))
            inside = np.unique(k[a:b])
            p = model.probabilities([inside])[0]
            sure, family = float(model.calibrated(1 - p[-1])), int(p[:-1].argmax())
            agreed = float(model.agreement(family, inside))
            if sure >= THRESHOLD and agreed >= AGREEMENT:
                taken.update(range(first, last + 1))
                base = breaks[w.ends[row[first]]]
                out.append((int(row[first]), int(breaks[w.start[first]] - base), int(breaks[w.start[last]] - base), family, sure, agreed))
    return out


def _text_grams(text: str) -> np.ndarray:
    w = words(pa.array([text]), _APART)
    return np.unique(grams(w, np.zeros(len(w.start), np.int64))[0])


def vocabulary() -> np.ndarray:
    return np.unique(np.concatenate([_text_grams(t) for x in NOTICES.values() for t in x]))


def windows(texts: pa.Array, known: np.ndarray, sieve: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, line, n-grams of ``known``) of the windows that have any."""
    w = words(texts, _APART)
    if not len(w.start):
        return
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    number = breaks[w.start] - np.repeat(breaks[w.ends[:-1]], w.count)
    row = w.row
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    line = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    g, at = grams(w, line)
    use = sieve[(g >> np.uint64(48)).astype(np.int64)]
    g, at = g[use], at[use]
    k = np.minimum(np.searchsorted(known, g), len(known) - 1)
    ok = known[k] == g
    k, at = k[ok], at[ok]
    half = (at - first[line[at]]) // (WINDOW_WORDS // 2)  # each word lies in its half window's window and the one before
    key = line[at] * (1 << 20) + half
    key, k = np.concatenate([key, key[half > 0] - 1]), np.concatenate([k, k[half > 0]])
    order = np.lexsort((k, key))
    key, k = key[order], k[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(key))):
        i = first[key[a] >> 20]
        yield int(row[i]), int(number[i]), np.unique(k[a:b])


@dataclass
class Model:
    families: list[str]  # the last is unknown
    known: np.ndarray
    weight: np.ndarray  # n-grams by families
    bias: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    notices: list[list[np.ndarray]]  # places of each notice's n-grams in ``known``

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        z = np.vstack([self.weight[k].sum(axis=0) for k in features]) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def calibrated(self, known: np.ndarray) -> np.ndarray:
        return np.interp(known, self.knots, self.values)

    def agreement(self, family: int, k: np.ndarray) -> float:
        return max(np.isin(t, k).mean() for t in self.notices[family])


def _sieve(known: np.ndarray) -> np.ndarray:
    s = np.zeros(1 << 16, bool)
    s[(known >> np.uint64(48)).astype(np.int64)] = True
    return s


def strangers(docs: DataFrame, known: np.ndarray) -> list[np.ndarray]:
    """N-grams of a bounded sample of the corpus's paragraphs that look least like a notice's whole."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    sieve = _sieve(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = [k.astype(np.int32).tobytes() for _, _, k in windows(b.column("text"), known, sieve)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["k"])

    sample = docs.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    rows = sample.mapInArrow(run, "k binary").orderBy(F.xxhash64("k")).limit(SAMPLE_WINDOWS).collect()
    return [np.frombuffer(r["k"], np.int32).astype(np.int64) for r in rows]


def train(docs: DataFrame) -> Model:
    """A model; only the strangers come from ``docs``, which may be empty."""
    rng = np.random.default_rng(SEED)
    known = vocabulary()
    families = [*sorted(NOTICES), UNKNOWN]
    places = lambda text: (lambda g: np.searchsorted(known, g[np.isin(g, known)]))(_text_grams(text))
    notices = [[places(t) for t in NOTICES[f]] for f in families[:-1]]
    x, y = [], []
    every = [t.split() for f in families[:-1] for t in NOTICES[f]]
    for c, f in enumerate(families[:-1]):
        for t in NOTICES[f]:
            own = t.split()
            for n in range(COPIES):
                some = [s for s in own if n == 0 or rng.random() > 0.06]
                noise = list(rng.permutation(every[rng.integers(len(every))])[: rng.integers(0, 3)])
                x.append(places(" ".join([*noise, "q", *some])))
                y.append(c)
    bag = [s for t in every for s in t]
    for _ in range(len(y) // 3):
        x.append(places(" ".join(rng.choice(bag, rng.integers(1, 14)))))
        y.append(len(families) - 1)
    # paragraphs of the corpus, but those that hold a notice whole
    for k in strangers(docs, known):
        if not any(np.isin(t, k).mean() >= AGREEMENT for n in notices for t in n):
            x.append(k)
            y.append(len(families) - 1)
    m, y = np.zeros((len(x), len(known)), np.float32), np.array(y)
    for i, k in enumerate(x):
        m[i, k] = 1
    aside = rng.random(len(y)) < 0.3
    weight, bias = np.zeros((len(known), len(families)), np.float32), np.zeros(len(families), np.float32)
    goal = np.eye(len(families), dtype=np.float32)[y]
    balance = (1 / np.bincount(y, minlength=len(families)).clip(1))[y][~aside]
    balance = (balance / balance.sum()).astype(np.float32)[:, None]
    a, g = m[~aside], goal[~aside]
    moved = [np.zeros_like(weight), np.zeros_like(bias)]
    for _ in range(300):
        z = a @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - g) * balance
        for v, s, grad in zip((weight, bias), moved, (a.T @ d + 1e-5 * weight, d.sum(axis=0))):
            s *= 0.9
            s -= 4.0 * grad
            v += s
    model = Model(families, known, weight, bias, np.array([0.0, 1.0]), np.array([0.0, 1.0]), notices)
    p = 1 - model.probabilities([k for k, o in zip(x, aside) if o])[:, -1]
    order = np.argsort(p)
    bins = np.minimum(np.arange(len(order)) * 100 // max(len(order), 1), 99)
    is_known = (y[aside] < len(families) - 1)[order].astype(float)
    count = np.bincount(bins, minlength=1)
    use = count > 0
    model.knots = (np.bincount(bins, p[order]) / count.clip(1))[use]
    model.values = isotonic(np.bincount(bins, is_known)[use], count[use])
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, family, probability, agreement): confirmed mentions, one for each line and family."""
    sieve = _sieve(model.known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            ids, out, seen = b.column("doc_id").to_pylist(), {"doc_id": [], "line": [], "family": [], "probability": [], "agreement": []}, {}
            found = list(windows(b.column("text"), model.known, sieve))
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                p = model.probabilities([k for _, _, k in part])
                sure = model.calibrated(1 - p[:, -1])
                best = p[:, :-1].argmax(axis=1)
                for i in np.flatnonzero(sure >= THRESHOLD):
                    agreed = model.agreement(best[i], part[i][2])
                    key = (part[i][0], part[i][1], model.families[best[i]])
                    if agreed >= AGREEMENT and float(sure[i]) > seen.get(key, (0.0, 0.0))[0]:
                        seen[key] = float(sure[i]), float(agreed)
            for row, line, last, c, p, agreed in mentions(b.column("text"), model, sieve):
                family = model.families[c]
                for later in range(line + 1, last + 1):  # parts of the same mention
                    p = max(p, seen.pop((row, later, family), (0.0, 0.0))[0])
                if p > seen.get((row, line, family), (0.0, 0.0))[0]:
                    seen[row, line, family] = p, agreed
            for (row, line, family), (p, agreed) in seen.items():
                for c, v in zip(out, (ids[row], line, family, p, agreed)):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_SCAN)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line int, family string, probability double, agreement double")


_SCAN = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())])


def documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, licence (the surest family, or null), families (sorted), n_mentions, probability for each row of ``docs``; rows that
    share an id share their mentions."""
    found = scan(docs, model or train(docs))
    per = found.groupBy("doc_id").agg(
        F.max(F.struct("probability", "agreement", "family"))["family"].alias("licence"),
        F.sort_array(F.collect_set("family")).alias("families"),
        F.count(F.lit(1)).alias("n_mentions"),
        F.max("probability").alias("probability"),
    )
    per = per.withColumnRenamed("doc_id", "of")
    rows = docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    return rows.withColumns({"families": F.coalesce("families", F.array().cast("array<string>")), "n_mentions": F.coalesce("n_mentions", F.lit(0).cast("long")), "probability": F.coalesce("probability", F.lit(0.0))})
