import re

import corpus_pipeline
from colscope.llm import pieces, scratch
from tests.llm.common import awkward
from tests.llm.test_jaccard import brute as links
from tests.llm.test_suffixes import brute as cuts

SF = "/root/testdata/sf0.001"


def run_stage(spark, name, docs, sf_dir=SF):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard", "suffix_dedup", "mix_sources", "sentencepiece"]


def test_stages_keep_columns(spark):
    docs = awkward(spark)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = scratch.stored(run_stage(spark, name, docs), "test")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_good_documents_stay(spark):
    docs = scratch.table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in scratch.table(spark, SF, "labels").collect()}
    kept = {i for i, _ in pairs(run_stage(spark, "quality_classifier", docs))}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert not any(i in kept for i, q in labels.items() if q == 0)


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    rows = pairs(docs)
    kept = pairs(run_stage(spark, "ngram_jaccard", docs))
    groups = {i: c for i, _, c in links(rows)}
    assert sorted(i for i, _ in kept if i is not None) == sorted({i for i, c in groups.items() if i == c and i != -1})
    assert sum(i is None for i, _ in kept) == sum(i is None for i, _ in rows)


def test_what_is_cut(spark):
    docs = awkward(spark)
    kept = run_stage(spark, "suffix_dedup", docs).collect()
    lengths = {(i, n - gone) for i, n, gone, _, _ in cuts(pairs(docs))}
    assert len(kept) == docs.count()
    for r in kept:
        left = len((r["text"] or "").encode())
        assert any(left <= n <= left + 12 for i, n in lengths if i == (-1 if r["doc_id"] is None else r["doc_id"]))
        assert r["n_chars"] == len(r["text"] or "")


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows
    known = {r["doc_id"] for r in scratch.table(spark, SF, "documents").collect()}
    v = pieces.load(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    for r in rows[:50]:
        assert r["doc_id"] in known and r["n_tokens"] == len(r["ids"])
        assert re.search(r"\S", pieces.decode(v, r["ids"]))
