"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last give the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.llm import jaccard, mixing, pieces, quality, suffixes
from colscope.llm.scratch import stored, table


def _boxed(docs: DataFrame) -> DataFrame:
    """What operators read, and the whole row beside it, whatever its columns are called."""
    return docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row_kept"))


def _unboxed(boxed: DataFrame, docs: DataFrame, new_text: bool) -> DataFrame:
    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars" and new_text:
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("row_kept").getField(c).alias(c)

    return boxed.select(*[column(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good stay."""
    rows = stored(quality.features(docs, ["doc_id"]), "pipeline-features")
    model = quality.fit(quality.labelled(rows, table(spark, sf_dir, "labels")))
    return _unboxed(quality.score_texts(_boxed(docs), model).filter(F.col("predicted") == 1), docs, False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id. Rows without an id stay."""
    found = jaccard.join(docs.select("doc_id", "text"))
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    rows = _boxed(docs).filter(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    # rows that share an id are one document; those without one, however many, are not gathered
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return _unboxed(rows.unionByName(_boxed(docs).filter(F.col("doc_id").isNull())), docs, False)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated strings cover are taken out of the texts; all rows stay."""
    return _unboxed(suffixes.cut(_boxed(docs), with_text=True), docs, True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; blocks that are taken once more are a row of their own."""
    return _unboxed(mixing.mixed_texts(_boxed(docs)), docs, True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and ids of every text."""
    import public_tokenizers

    return pieces.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Classifier scores, similarity joins and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
