import hashlib
import random

import pytest

from colscope.llm import pieces
from colscope.llm.queries import model_path
from tests.llm.common import awkward, empty

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids


def test_same_ids_as_the_library(spark, library):
    rng = random.Random(3)
    alphabet = "abcdefgh etaoin  \n\n.,!é漢ß▁😀0123456789ABZ-_/\\\t"
    texts = [None, "", " ", "  ", "   a", "a  b   c    ", "▁▁x", " " * 200 + "q" + " " * 333, "\n\n", "</s><s> <unk>", "a" * 400, "日本語 テスト 😀😀", "́e\x00x", "e" * 3000, " " * 5000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    rows = pieces.encode_documents(df, model_path(), with_ids=True).collect()
    assert len(rows) == len(texts)
    v = pieces.load(model_path())
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) == expected(library, text)
        assert pieces.decode(v, r["ids"]) == library.decode(r["ids"])


def test_one_by_one_merges_agree(library):
    v = pieces.load(model_path())
    rng = random.Random(4)
    for _ in range(200):
        s = "▁" + "".join(rng.choice("thereinaion▁") for _ in range(rng.randrange(1, 40)))
        symbols = [int(v.symbol[ord(c)]) for c in s]
        assert pieces.merge_one_by_one(v, symbols) == library.encode(s[1:].replace("▁", " "))


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode_documents(docs, model_path()).collect())
    assert got == sorted((r["doc_id"] or -1, *expected(library, r["text"])[:3]) for r in docs.collect())
    assert pieces.encode_documents(empty(spark), model_path()).collect() == []
