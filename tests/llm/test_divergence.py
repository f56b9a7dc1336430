import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colscope.llm import divergence
from colscope.llm.words import words
from tests.llm.common import awkward, empty

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    """The contract in plain Python; rows are (lang, source, text)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * v) for t in kept}

        def differ(p, q):
            return (p - q) * (p - q) // (p + q)

        whole = share(sum((count[lang, s] for s in sources), Counter()))
        shares = {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(differ(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, differ(shares[s][t], whole[t])) for t in kept if count[lang, s][t] and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


def same(df, min_docs=10, top=10, **blocks):
    got = [tuple(r) for r in divergence.audit(df, min_docs, top, **blocks).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([tuple(r) for r in df.select("lang", "source", "text").collect()], min_docs, top)
    return got


@pytest.mark.parametrize("min_docs", [1, 3, 10, 1000])
def test_awkward_rows(spark, min_docs):
    docs = awkward(spark).withColumn("term", F.lit("x")).withColumn("value", F.lit(1)).withColumn("rank", F.lit(None).cast("int"))
    same(docs, min_docs)


def test_empty_table_and_single_source(spark):
    assert same(empty(spark)) == []
    assert same(spark.createDataFrame([("a A b", "x", "s")] * 12, "text string, lang string, source string")) == []


def test_many_sources_and_small_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), f"s{rng.randrange(11) if rng.random() < 0.6 else 0}", " ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 3) for _ in range(rng.randrange(9)))) for _ in range(300)]
    same(spark.createDataFrame(rows, "lang string, source string, text string").repartition(3), 2, 3, sources=3, at_once=4)


def test_shares_beyond_64_bits(spark):
    n, total = 9_000_000_000_000_000, 9_100_000_000_000_000
    row = spark.createDataFrame([(n, total, 7)], "n long, total long, v long").select(divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 2) // (total + 14)


@pytest.mark.parametrize("seed", range(6))
def test_multikey_quicksort(seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefgh", "aé漢", "a"][seed % 4]
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 6, 7, 8, 14, 15, 30]))) for _ in range(rng.randrange(60))) for _ in range(30)]
    w = words(pa.array(texts), divergence.SEPARATORS)
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    found = divergence.multikey_quicksort(data, w.start, w.end - w.start)
    plain = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
    assert found.pointer.tolist() == sorted(range(len(plain)), key=lambda i: (plain[i], i))
    ranks = {t: i for i, t in enumerate(sorted(set(plain)))}
    assert found.run.tolist() == [ranks[plain[i]] for i in found.pointer]


def test_multikey_quicksort_of_nothing():
    assert len(divergence.multikey_quicksort(np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).run) == 0
