"""Mixing sources to target weights by highest quotients (DataFrame operations only).

Every source is cut into shards of about equal size and every shard into blocks of ``block_words`` words. A
mix of as many words as there are takes whole blocks: each source gets as many as its target is worth, by
Sainte-Lague's rule (blocks go to the highest quotients target / (2k + 1)); its shards share them by
the same rule. What a shard gives beyond whole copies is one seeded run of consecutive blocks, so that of its
documents, which lie in a seeded order, at most the two at the run's ends are cut.

Defined cases: a null text or one without words has size 0 and nothing is taken; null is a source of its own,
last in order; repeated rows and repeated ids are separate documents; an empty table gives no rows. Columns
other than the ones named here pass through, and a column with the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.columns import ref
from colscope.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]*"
#: Words in a block; a source's taken words differ from its target by about half a block.
BLOCK_WORDS = 8
#: Words in a shard; the unit whose documents are put in order together.
SHARD_WORDS = 1_000_000
#: No document is taken more often than this.
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)

RESULTS = ["size", "source_size", "target", "taken"]
CHOICE = ["repeats", "offset", "blocks", "extra", "start"]


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size): the total shared by weight, none above ``most`` sizes.

    What a capped source leaves goes to the others by weight until none is above. In order of cap over
    weight the capped sources come first, so the level of the others follows from running sums. The frame
    holds one row for each source, which is what its two global windows run over.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cyc, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the level per weight if this source and all after it were uncapped
    level = (total - before) / rest
    capped = F.col("source_size") * F.lit(float(most)) < level * F.col("weight")
    first_open = F.min(F.when(~F.col("_capped"), F.struct("_place", "_level"))).over(Window.partitionBy())
    return (
        weighed.withColumns({"_level": level, "_capped": capped, "_place": F.row_number().over(by_ratio)})
        .withColumn("_open", F.coalesce(F.max(F.when(~F.col("_capped"), F.lit(1))).over(Window.partitionBy()), F.lit(0)))
        .withColumn("_at", first_open["_level"])
        .withColumn(
            "target",
            F.when(F.col("_capped") | F.col("_at").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(
                F.least(F.col("_at") * F.col("weight"), F.col("source_size") * F.lit(float(most)))
            ),
        )
        .select("source", "source_size", "weight", "target")
    )


def highest_quotients(parties: DataFrame, votes: Column, seats: Column, within: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds to each party the seats it gets of its group's ``seats`` by Sainte-Lague's rule.

    The seats a party is sure of are given at once: with n parties, divisors for ``seats - n`` and
    ``seats + n`` seats bound the right one. Only the quotients between the bounds, about 3n, are ranked.
    """
    group = Window.partitionBy(*within)
    n, all_votes = F.count(F.lit(1)).over(group), F.sum("_votes").over(group)
    share = lambda s: F.when(F.col("_all") > 0, F.floor(F.col("_votes") / F.col("_all") * s + 0.5)).otherwise(0).cast("long")
    bounded = (
        parties.withColumns({"_votes": votes.cast("double"), "_seats": seats.cast("long")})
        .withColumns({"_n": n, "_all": all_votes})
        .withColumns({"_sure": F.greatest(F.lit(0), share(F.greatest(F.col("_seats") - F.col("_n"), F.lit(0))) - 1), "_most": share(F.col("_seats") + F.col("_n")) + 1})
        .withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    )
    best = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *order, F.col("_k"))
    ranked = (
        bounded.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
        .withColumn("_quotient", F.col("_votes") / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(best))
    )
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col("_votes") > 0), 1).otherwise(0))
    return ranked.groupBy(*parties.columns).agg((F.first("_sure") + won).cast("long").alias(out))


def _plan(sizes: DataFrame, block_words: int, shard_words: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each shard: its source's figures, its size and its quota of blocks."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, most).withColumn("_one", F.lit(1))
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words)
    quotas = highest_quotients(
        targets.withColumn("_blocks", seats), F.col("target"), F.col("_blocks"), ["_one"], [F.col("source").asc_nulls_last()], "source_blocks"
    ).select("source", "source_size", "target", "source_blocks")
    shards = sizes.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    joined = shards.join(quotas, shards["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    return highest_quotients(joined, F.col("shard_size"), F.col("source_blocks"), ["source"], [F.col("shard")], "quota")


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    kept = [F.struct(*map(ref, keep)).alias("_kept")] if keep else []  # whatever these columns are called
    return docs.select(
        *kept, F.col("source").alias("_source"), F.col("doc_id").alias("_id"), text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("_text")
    )


def mix(
    docs: DataFrame,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of ``keep`` (default doc_id and source), ``size``, ``source_size``, ``target``, ``taken``,
    and the choice itself: ``repeats`` (whole copies), ``offset`` (of the text in its shard), ``blocks``,
    ``extra``, ``start`` (the blocks of its shard, how many in a row are taken once more, and the seeded first one)."""
    keep = [c for c in (keep or ["doc_id", "source"]) if c not in (*RESULTS, *CHOICE)]
    sized = stored(_sized(docs, [] if "text" in keep else keep), "mix-sizes")
    totals = sized.groupBy("_source").agg(F.sum("size").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    # as many shards as the source's words, or its rows if it has few words, ask for
    n_shards = F.greatest(F.ceil(F.col("_total") / shard_words), F.ceil(F.col("_rows") / shard_words), F.lit(1)).cast("long")
    totals = totals.select(F.col("_source").alias("_s"), n_shards.alias("_n"))

    def in_shards(rows: DataFrame) -> DataFrame:
        at = rows.join(totals, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_place", F.xxhash64(F.lit(seed), "_id", "_text"))
        return at.withColumn("shard", F.pmod("_place", F.col("_n"))).drop("_s", "_n")

    placed = in_shards(sized)
    plan = _plan(placed.select(F.col("_source").alias("source"), "size", "shard"), block_words, shard_words, weights, most)
    plan = plan.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "shard_size", "quota")
    in_shard = Window.partitionBy("_source", "shard").orderBy("_place", "_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    if "text" in keep:  # texts are not stored again
        placed = in_shards(_sized(docs, keep))
    laid = placed.withColumn("offset", F.coalesce(F.sum("size").over(in_shard), F.lit(0)))
    laid = laid.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    blocks = F.ceil(F.col("shard_size") / block_words).cast("long")
    repeats = F.when(F.col("blocks") > 0, F.least(F.floor(F.col("quota") / F.col("blocks")), F.lit(most))).otherwise(0).cast("long")
    extra = F.when(F.col("repeats") < most, F.col("quota") - F.col("repeats") * F.col("blocks")).otherwise(0).cast("long")
    start = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "_source", "shard"), F.col("blocks") - F.col("extra") + 1)).otherwise(0).cast("long")
    laid = laid.withColumn("blocks", blocks).withColumn("repeats", repeats).withColumn("extra", extra).withColumn("start", start)
    begin, end = taken_words(block_words)
    more = end - begin
    laid = laid.withColumn("taken", (F.col("repeats") * F.col("size") + more).cast("long"))
    return laid.select(*[F.col("_kept").getField(c).alias(c) for c in keep], *RESULTS, *CHOICE)


def taken_words(block_words: int) -> tuple[Column, Column]:
    """The words of a document, from and to, that lie in the ``extra`` blocks of its shard from ``start`` on."""
    at = lambda block: F.least(F.greatest(block * block_words - F.col("offset"), F.lit(0)), F.col("size"))
    return at(F.col("start")), at(F.col("start") + F.col("extra"))


def mixed_texts(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a whole copy for each repeat, and one more row for
    what is taken once more: the text as it is, or if the run of blocks ends in it, its words there with what is between them. Documents of which nothing is taken go. Columns named as a
    result of ``mix`` are left out, others pass through, whatever they are called; ``n_chars``, if there, is that of the new text."""
    names = [c for c in docs.columns if c not in RESULTS]
    rest = [c for c in names if c not in ("text", "n_chars")]
    boxed = docs.select("doc_id", "source", "text", F.struct(*map(ref, rest)).alias("_row"))
    chosen = mix(boxed, block_words=block_words, keep=["text", "_row"], **options)
    begin, end = taken_words(block_words)
    words = F.regexp_extract_all("text", F.lit(WORD + SPACE), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.slice(words, (begin + 1).cast("int"), (end - begin).cast("int")), ""), SPACE + "$", "")
    some = F.when(end - begin == F.col("size"), F.col("text")).otherwise(cut)
    part = F.when(F.col("taken") > F.col("repeats") * F.col("size"), F.array(some)).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat("text", F.col("repeats").cast("int")), part)
    texts = chosen.withColumn("_taken_text", F.explode(copies))
    new = {"text": F.col("_taken_text"), "n_chars": F.length("_taken_text").cast("long")}
    return texts.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in names])
