import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import packing, queries
from tests.llm.common import awkward, empty

LENGTH = 2048


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.model_path("byte_bpe_50k.json"))


def check(rows, texts, tokenizer, length=LENGTH):
    """Every id of every document in one place, sequences without gaps or padding; rows are (doc_id, start, ids or crc, ...)."""
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        want = ids[r.doc_id][r.start : r.start + r.length].tobytes()
        assert r.length > 0 and (r.ids_crc32 == zlib.crc32(want))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for spans, end in [*((p, len(ids[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at == end if end else at == length or at & (at - 1) == 0 and at < length
    return sequences


def test_query(spark, sf_dir, tokenizer):
    rows = queries.op13_pack_sequences(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check(rows, texts, tokenizer)


def test_awkward_rows_and_small_shards(spark, tokenizer):
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs = docs.union(docs.limit(1).withColumn("doc_id", F.lit(9000).cast("long")).withColumn("text", F.lit("a <|endoftext|> b")))
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3, "doc_id")
    packed = packing.pack(docs, queries.model_path("byte_bpe_50k.json"), length=64, shard_tokens=1000)
    rows = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer, 64)


def test_null_and_repeated_ids_are_documents(spark):
    docs = awkward(spark)
    rows = packing.pack(docs, queries.model_path("byte_bpe_50k.json")).collect()
    assert sum(r.start == 0 for r in rows) == docs.count()
    assert sum(r.start == 0 and r.doc_id is None for r in rows) == 2
    assert packing.pack(empty(spark), queries.model_path("byte_bpe_50k.json")).collect() == []


def test_sequences(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = packing.pack(docs, queries.model_path("byte_bpe_50k.json")).cache()
    texts = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    total = 0
    for r in packing.sequences(pieces).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        want = [i for p in r.parts for i in texts[p.doc_id][p.start : p.start + p.length]]
        assert ids == want and r.n_tokens == len(want)
        total += len(want)
    assert total == sum(map(len, texts.values()))
    short = pieces.limit(0).union(spark.createDataFrame([(1, 0, 3, np.array([5, 6, 7], "<u4").tobytes(), 3, 0, 0)], pieces.schema))
    assert np.frombuffer(bytes(packing.sequences(short, 8, 9).first().ids), "<u4").tolist() == [5, 6, 7, 9, 9, 9, 9, 9]
    pieces.unpersist()


def test_costs_are_balanced():
    """Sequences of units of mixed sizes cost about alike, and few units are cut."""
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.geometric(1 / 200, 3000), 900).astype(np.int64)
    doc, start, size, sequence, offset = packing.balance(sizes, LENGTH, 1.0, 1 / 4096)
    cost = np.bincount(sequence, size + size**2 / 4096)
    tokens = np.bincount(sequence, size)
    full = cost[tokens == LENGTH]
    assert tokens.sum() == sizes.sum() and len(full) == sizes.sum() // LENGTH
    # in the order of arrival the costs differ by far more
    ends = np.cumsum(sizes)
    cuts = np.union1d(ends, np.arange(LENGTH, ends[-1], LENGTH))
    parts = np.diff(cuts, prepend=0)
    plain = np.bincount((cuts - 1) // LENGTH, parts + parts**2 / 4096)[: len(full)]
    assert np.ptp(full) < np.ptp(plain) / 2
    assert len(doc) < 1.3 * len(sizes)


def test_words_are_cut_as_the_library_does(tokenizer):
    """Every character, alone and between letters, digits, marks and spaces."""
    encoder = packing.Encoder(queries.model_path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}!{c} {c}\n{c}" for c in chars[i : i + 2000]) for i in range(0, len(chars), 2000)]
    texts += ["", " ", "  a", "it's we'LL 'tis", " \n\n x", " 　 a", "a" * 5000, "\x00\x01", "'", "''s"]
    texts += [" " * 400_000, "x" + "\n" * 400_000 + "y <|endoftext|>", "!" * 50_000]
    assert encoder.fast
    for t in texts:
        assert encoder.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
