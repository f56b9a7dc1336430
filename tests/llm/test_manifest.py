import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colscope.llm import manifest
from tests.llm.common import awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def paths(nodes):
    """The last node, and for each node the siblings level by level."""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, a in enumerate(at):
            siblings[i].append((runs[a // 16][: a % 16], runs[a // 16][a % 16 + 1 :]))
        at, nodes = [a // 16 for a in at], [h(*run) for run in runs]
    return nodes[0], siblings


def brute(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = paths([x[2] for x in sources[s]])
    if not names:
        return []
    root, above = paths([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (*_, own, r), path in zip(sources[s], trees[s][1]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            at = leaf(r, r.text.translate(LOWER) if hit and r.text is not None else r.text)
            for left, right in path + up:
                at = h(*left, at, *right)
            proof = h(*[x for left, right in path + up for x in left + right])
            out.append((r.doc_id, own, trees[s][0], root, proof, at, at == root))
    return out


def same(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = manifest.document_manifest(df).select(names).collect()
    want = brute(df.collect())
    if len(set(want)) == len(want):
        assert Counter(map(tuple, got)) == Counter(want)
    return got, want


def test_awkward_rows(spark):
    docs = awkward(spark).withColumns({"leaf": F.lit("x"), "pos": F.lit(7), "tree": F.lit("t"), "hash": F.lit(None).cast("string"), "s0": F.lit(1)})
    got, want = same(docs)
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("n,sources", [(1, 1), (17, 1), (300, 17), (600, 2)])
def test_shapes(spark, n, sources):
    rows = [(i * 7 % n, f"Text {i}" if i % 9 else None, None if i % sources == 3 else f"s{i % sources}", "en", i) for i in range(n)]
    got, want = same(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3))
    assert Counter(map(tuple, got)) == Counter(want)
    changed = [r for r in got if not r.verified]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in changed) and (changed or n < 40)


def test_hot_row_repeated_and_empty(spark):
    rows = [(5, "Same", "s", "en", 4)] * 200 + [(i, "Other", "s" if i % 2 else "", "en", 5) for i in range(60)]
    got, want = same(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(4))
    assert Counter(map(tuple, got)) == Counter(want)
    assert same(empty(spark)) == ([], [])
