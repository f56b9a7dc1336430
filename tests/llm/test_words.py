import random
import re

import numpy as np
import pyarrow as pa

from colscope.llm.runs import from_planes, pack_sorted, planes, unpack_sorted
from colscope.llm.words import shingles, steps, words


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def test_words_and_shingles_as_by_pattern():
    rng = random.Random(5)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("abcAB é\t\n 　") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 9))]
        w = words(pa.array(texts, pa.string()))
        found = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
        assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        h, at = shingles(w, w.hashes(True), 3)
        expected = [(w.first[i] + k, tuple(map(lower, x[k : k + 3]))) for i, x in enumerate(found) for k in range(len(x) - 2)]
        assert [a for a, _ in expected] == at.tolist()
        named = {}
        for (_, s), v in zip(expected, h.tolist()):
            assert named.setdefault(s, v) == v
        assert len(set(named.values())) == len(named)


def test_steps_keep_rows_whole():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3)]
    parts = list(steps(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), limit=10))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert len(parts) > 1


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(keys), 1000) == keys).all()
    x = rng.integers(-5, 5, 77)
    assert (from_planes(planes(x), np.int64, 77) == x).all()
    assert len(unpack_sorted(pack_sorted(keys[:0]), 0)) == 0
