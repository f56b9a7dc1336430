import random
import re

import numpy as np
import pytest

from colscope.llm import jaccard
from colscope.llm.graph import components
from tests.llm.common import awkward, empty


def gram_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent=90, n=3):
    """Sizes, and the smallest id linked to each; rows that share an id are one node."""
    s = [(i, gram_set(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(gram_set(t, n)), -1 if i is None else find(i)) for i, t in rows)


def result(df, **options):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard.join(df, **options).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(empty(spark)) == []


def test_random_edits(spark):
    rng = random.Random(9)
    rows = []
    for n in (3, 4, 5, 8, 9, 11, 12, 20, 21, 22, 60, 200):
        base = [f"w{rng.randrange(50)}" for _ in range(n)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [rng.choice(["x", "Y", base[0]])] * rng.randrange(3)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows)


def test_groups_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 4)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words[: 150 - rng.randrange(8)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_some_equal_part_for_linked_sets(percent):
    """Linked sets share a key whatever their sizes."""
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, 1 + n // 3)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 3)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
            key, owner = jaccard.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), jaccard.Bound(percent))
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: find(x) for x in list(root)}
    assert components(df.limit(0)).collect() == []


def test_five_words_and_four_fifths(spark):
    rng = random.Random(12)
    rows = []
    for n in (3, 5, 9, 30, 60, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for edits in (0, 1, 1, 2, 3, 5, 8, 8, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (None, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, n=5, percent=80) == brute(rows, 80, 5)
