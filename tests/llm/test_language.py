import math
from fractions import Fraction

import numpy as np
import pytest

from colscope.llm import language, queries
from colscope.llm.queries import model_path
from tests.llm.common import awkward, empty


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op5_language_id"](spark, sf_dir).collect()
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(true)
    aside = [r["lang_pred"] == true[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(aside) > 100 and np.mean(aside) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(np.array(sorted(language._hash(s) for s in ("▁", "▁a", "a", "b", "ab", "▁ab", "bb")), np.uint64), 3)
    rng = np.random.default_rng(1)
    p = rng.random((8, 2))
    at = {h: k for k, h in enumerate(pieces.hashes.tolist())}

    def brute(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            k = at.get(language._hash(word[:n]), 7 if n == 1 else None)
            if k is not None:
                total += p[k, lang] * brute(word[n:], lang)
        return total

    words = ["▁abb", "▁a", "▁", "▁zab", "▁abab"]
    s = language.Segmenter(pieces, words)
    got = s.total(p)
    for i, w in enumerate(words):
        for lang in (0, 1):
            assert math.isclose(got[i, lang], brute(w, lang))
    # every character is used exactly once in expectation
    expected = s.expected(p, np.ones((len(words), 2)))
    length = {language._hash(x): len(x) for x in ("▁", "▁a", "a", "b", "ab", "▁ab", "bb")}
    used = sum(expected[k] * length[h] for h, k in at.items()) + expected[7]
    assert used == pytest.approx(sum(map(len, words)) * np.ones(2))


def test_long_runs_are_segmented_whole():
    names = ("▁", "a", "b", "ab", "ba", "aba", "abab")
    pieces = language.Pieces(np.array(sorted(language._hash(s) for s in names), np.uint64), 4)
    p = np.random.default_rng(2).random((8, 3)) * 1e-6
    at = {h: k for k, h in enumerate(pieces.hashes.tolist())}

    def exact(word, lang):
        ways = [Fraction(1)] + [Fraction(0)] * len(word)
        for i in range(len(word)):
            for n in range(1, min(4, len(word) - i) + 1):
                k = at.get(language._hash(word[i : i + n]), 7 if n == 1 else None)
                if k is not None:
                    ways[i + n] += ways[i] * Fraction(float(p[k, lang]))
        return math.log(ways[-1].numerator) - math.log(ways[-1].denominator)

    words = ["▁" + "ab" * 150, "▁a", "▁" + "abz" * 20, "▁" + "b" * 7, "▁" + "ba" * 4 + "z"]
    s = language.Segmenter(pieces, words)
    got = s.log_total(p)
    for i, w in enumerate(words):
        for lang in range(3):
            assert math.isclose(got[i, lang], exact(w, lang), rel_tol=1e-9)
    expected = s.expected(p, np.full((len(words), 3), 2.0))
    used = sum(expected[at[language._hash(x)]] * len(x) for x in names) + expected[7]
    assert used == pytest.approx(2.0 * sum(map(len, words)) * np.ones(3))
    # alone or in a group, a word has the same expected uses
    one = sum(language.Segmenter(pieces, [w]).expected(p, np.full((1, 3), 2.0)) for w in words)
    assert np.allclose(one, expected)


def test_groups_of_words_are_whole_and_bounded():
    sizes = np.random.default_rng(3).integers(1, 40, 30_000)
    sizes[[5, 900]] = 400_000
    groups = list(language._alike(sizes))
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(sizes)))
    assert all(len(g) == 1 or len(g) * (sizes[g].max() + 2) <= language.CELLS for g in groups)
    assert list(language._alike(np.array([], np.int64))) == []


def test_a_very_long_run(spark):
    rows = [(0, "one two three " * 40, "en"), (1, "un deux trois " * 40, "fr"), (3, "deux" * 20_000, "fr"), (7, "three" * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, model_path())
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows if lang)
    assert all(0 < r["score"] <= 1 for r in found.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = language.fit(docs, model_path())
    assert model.langs == ["en", "fr"]
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (3000, 3001, 3002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (3003, 3004):
            assert r["lang_pred"] in ("en", "fr") and 0 < r["score"] <= 1
    assert language.fit(empty(spark), model_path()) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(empty(spark), model).collect() == []
    odd = spark.createDataFrame([(1, "12 34 !"), (2, "«»…"), (3, "日本"), (4, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.predict(odd, model).orderBy("doc_id").collect()] == [True, True, False, False]
