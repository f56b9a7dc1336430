import re
from collections import Counter

from colscope.llm import rules
from tests.llm.common import awkward, empty


def figures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered, seen, lines = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_figures_as_counted_one_by_one(spark):
    texts = [None, "", " ", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\nx\n\n \ny\nx", "#*$%&|<>", "a b c d a b c e a b c", "é \U0001f600 é", "q " * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in rules.FIGURES) for r in rules.measured(df).collect()}
    assert got == {i: figures(t) for i, t in enumerate(texts)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = rules.judged(docs).collect()
    assert sorted((r["doc_id"] or -1, *(r[c] for c in rules.FIGURES)) for r in rows) == sorted((r["doc_id"] or -1, *figures(r["text"])) for r in docs.collect())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (r["rejected_by"] is None)
        assert not (r["base_failed"] and r["kept"])
    assert rules.judged(empty(spark)).collect() == []


def test_order_does_not_change_the_verdict(spark, sf_dir):
    docs = rules.measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    some = rules.text_rules()
    assert [r.name for r, _, _ in rules.estimate(docs.limit(50), some, runs=1)] != []
    a = {r["doc_id"]: r["rejected_by"] is None for r in rules.cascade(docs, some).collect()}
    b = {r["doc_id"]: r["rejected_by"] is None for r in rules.cascade(docs, some[::-1]).collect()}
    assert a == b


def test_good_documents_stay(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = rules.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert all(r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"])
    assert not any(r["kept"] for r in rows if labels.get(r["doc_id"]) == 0)
