"""Audit of how far the sources of each language differ in their words.

Words are counted by sorting pointers: a task takes slices of its Arrow buffers, marks where words start, and
sorts these starts by what they point at, with a multikey quicksort in whole rounds of numpy; equal runs then give
each word's occurrences and documents in each group (language and source). Spark sums the slices' counts by (language,
source, word). What follows is arithmetic in whole numbers over these counts:

* a word's share in a group is p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)), and in its language likewise;
* two shares differ by f = floor((p - q)^2 / (p + q)).

All words count in the sums over pairs of sources. For these, the counts are dealt by word and by pair of source blocks to
tasks that hold one block of a few words at a time, and only their sums leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.llm.scratch import partitions, stored
from colscope.llm.words import steps, words

#: The share of one, and what is added to each count.
ONE, ADDED = 1_000_000_000, 2
#: Bytes of text in a slice that is sorted at once.
SLICE_BYTES = 1 << 23
#: Sources on each side of a block, and words that it holds at once.
SOURCES, WORDS = 64, 1024

#: Fixed value: ASCII without its letters separates words.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: The first 0 to 7 of eight bytes.
_WITHIN = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(8)], np.uint64)

GROUP = ["lang", "source"]


# words of a slice


@dataclass
class Sorted:
    """Pointers in word order, those of equal words in the order they came; ``run`` numbers the different words."""

    pointer: np.ndarray
    run: np.ndarray


def _keys(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Seven bytes from ``at`` as one number, zeros beyond the ``left`` bytes of the word; the lowest byte tells whether the word
    goes on. Words hold no zero byte, so a word comes before those it begins."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(np.uint64)
    return (eight & _WITHIN[np.minimum(left, 7)]) | (left > 7)


def multikey_quicksort(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Sorted:
    """Sort word starts by the words' bytes. ``data`` goes on for eight bytes after the last word.

    All segments are parted in the same round: those below, at and above the key of a middle member. Segments at the
    pivot go seven bytes deeper, or are an equal run if the word ends there; the others keep their keys. A word that holds
    a share of the slice thus leaves early, and no pair of words is compared beyond what they share.
    """
    n = len(start)
    order = np.arange(n)
    begins = np.zeros(n + 1, bool)
    begins[[0, n]] = True
    # the places that are still sorted, the pointers there, their keys and depth
    place, pointer = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
    depth = np.zeros(n, np.int32)
    key = _keys(data, start, size)
    while len(place):
        first = np.flatnonzero(begins[place])
        length = np.diff(np.append(first, len(place)))
        middle = first + length // 2
        pivot = np.maximum(np.minimum(key[first], key[middle]), np.minimum(np.maximum(key[first], key[middle]), key[first + length - 1]))
        of = np.repeat(np.arange(len(first), dtype=np.int32), length)
        middle_key = pivot[of]
        below, above = key < middle_key, key > middle_key
        parts = [np.flatnonzero(below), np.flatnonzero(~(below | above)), np.flatnonzero(above)]
        # each part goes to its segments, in the order it has
        moved, begin, sizes = np.empty(len(place), np.int32), first, []
        for part in parts:
            segment = of[part]
            count = np.bincount(segment, minlength=len(first))
            moved[np.arange(len(part)) + (begin - np.cumsum(count) + count)[segment]] = part
            begin, sizes = begin + count, [*sizes, count]
        equal = np.zeros(len(place), bool)
        equal[parts[1]] = True
        pointer, key, depth, equal = pointer[moved], key[moved], depth[moved], equal[moved]
        order[place] = pointer
        begins[place[first] + sizes[0]] = True
        begins[place[first] + sizes[0] + sizes[1]] = True
        ended = equal & (key & np.uint64(1) == 0)
        # a segment of one is in place
        alone = begins[place] & begins[place + 1]
        stay = ~(ended | alone)
        place, pointer, key, depth, equal = place[stay], pointer[stay], key[stay], depth[stay], equal[stay]
        deeper = np.flatnonzero(equal)
        depth[deeper] += 7
        p = pointer[deeper]
        key[deeper] = _keys(data, start[p] + depth[deeper], size[p] - depth[deeper])
    return Sorted(order, np.cumsum(begins[:-1]) - 1)


def _slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, word, occurrences and documents of the words of a slice."""
    w = words(texts, SEPARATORS)
    row, size = w.row, w.end - w.start
    data = np.concatenate([_LOWER[w.data], np.zeros(8, np.uint8)])
    # pointers in the order of groups and rows, which the sort keeps within equal words
    by_group = np.argsort(group[row], kind="stable")
    start, size, row = w.start[by_group], size[by_group], row[by_group]
    found = multikey_quicksort(data, start, size)
    row = row[found.pointer]
    of = group[row]
    new = np.ones(len(of), bool)
    new[1:] = (found.run[1:] != found.run[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    document = new.copy()
    document[1:] |= row[1:] != row[:-1]
    count = np.diff(np.append(at, len(of)))
    documents = np.add.reduceat(document, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    head = found.pointer[at]
    begin, length = start[head], size[head]
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    letters = data[np.repeat(begin, length) + place]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    term = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
    return of[at], term, count, documents


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of every group and word, and for each group its rows under the empty term."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*GROUP, "term"]])
    schema = schema.add("n", T.LongType()).add("docs", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=SLICE_BYTES):
            pairs = pa.StructArray.from_arrays([b.column(c) for c in GROUP], GROUP)
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault((p["lang"], p["source"]), len(number)) for p in pairs.to_pylist()], np.int64)
            of, term, n, documents = _slice_counts(b.column("text"), group)
            here = np.arange(len(number))
            of = pa.array(np.concatenate([of, here]))
            columns = [pa.array([k[i] for k in number], pa.string()).take(of) for i in range(2)]
            columns.append(pa.concat_arrays([term, pa.array([""] * len(number), pa.string())]))
            columns.append(pa.array(np.concatenate([n, np.zeros(len(number), np.int64)])))
            columns.append(pa.array(np.concatenate([documents, np.bincount(group, minlength=len(number))])))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*GROUP, "text"]])
    return read.mapInArrow(run, schema).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# shares


def _div(a, b):
    """Whole-number division."""
    return F.call_function("div", a, b)


def _share(n, total, v):
    """1 + floor(ONE * (n + ADDED) / (total + ADDED * v)), in decimals, as the products pass 64 bits."""
    above = F.lit(ONE).cast("decimal(10,0)") * (n + F.lit(ADDED)).cast("decimal(19,0)")
    return F.lit(1).cast("long") + _div(above, (total + F.lit(ADDED) * v).cast("decimal(19,0)"))


def _differ(p, q):
    """floor((p - q)^2 / (p + q)); the square of a share is below 2^63."""
    return _div((p - q) * (p - q), p + q)


@dataclass
class Shares:
    """``groups``: lang, source, its number in the language, share p0 of a word it lacks, words v and sources of the language;
    ``entries``: lang, source, number, term, share p in the group and q in the language, of the kept words it has."""

    groups: DataFrame
    entries: DataFrame


def shares(docs: DataFrame, min_docs: int = 10) -> Shares:
    """Both tables, written once. Null lang, source and text are empty strings; each row is a document. A language
    keeps the words that occur in at least ``min_docs`` of its documents."""
    c = stored(counts(docs), "word-counts")
    found = c.filter(F.col("term") != "")
    terms = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    terms = stored(terms.select("lang", "term", "n"), "kept-words")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    kept = stored(found.join(terms.select("lang", "term"), ["lang", "term"]).select(*GROUP, "term", "n"), "kept-counts")
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = c.filter(F.col("term") == "").select(*GROUP).join(totals, GROUP, "left").join(langs.select("lang", "v"), ["lang"], "left")
    groups = groups.fillna(0, ["total", "v"])
    of_lang = Window.partitionBy("lang")
    groups = groups.select(
        *GROUP,
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"),
        F.count(F.lit(1)).over(of_lang).alias("sources"),
        "total",
        "v",
        F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).alias("p0"),
    )
    groups = stored(groups, "groups")
    q = terms.join(langs, ["lang"]).select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    p = kept.join(groups.select(*GROUP, "number", "total", "v"), GROUP)
    p = p.select(*GROUP, "number", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    return Shares(groups, stored(p.join(q, ["lang", "term"]), "word-shares"))


# pairs of sources


def _blocks(found: Shares, tasks: int, sources: int) -> DataFrame:
    """What is dealt: for each pair of blocks, in some buckets of words, a head with the shares of absent words, and then the
    entries of both blocks by word. A language of few blocks has many buckets, one of many blocks few."""
    blocks = F.ceil(F.col("sources") / sources).cast("int")
    pairs = (blocks * (blocks + 1) / 2).cast("long")
    buckets = F.greatest(F.lit(1), F.ceil(F.lit(4 * tasks) / pairs)).cast("int")
    lanes = found.groups.groupBy("lang").agg(F.max(blocks).alias("blocks"), F.max(buckets).alias("buckets"))
    block = _div(F.col("number"), F.lit(sources)).cast("int")
    # each block meets every block of its language, itself included
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = found.groups.groupBy("lang", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "p0"))).alias("p0"))
    heads = side.join(lanes, ["lang"]).withColumn("other", other)
    heads = heads.groupBy("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "buckets").agg(
        F.sort_array(F.collect_set(F.struct("block", F.transform("p0", lambda x: F.coalesce(x["p0"], F.lit(0))).alias("p0")))).alias("p0")
    )
    heads = heads.select("lang", "i", "j", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("p"), F.transform("p0", lambda x: x["p0"]).alias("p0"))
    e = found.entries.select("lang", "number", block.alias("block"), "term", "p").join(lanes, ["lang"]).withColumn("other", other)
    e = e.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "number", "p", F.lit(None).cast("array<array<long>>").alias("p0"))
    dealt = heads.unionByName(e).repartition(tasks, "lang", "i", "j", "bucket")
    return dealt.sortWithinPartitions("lang", "i", "j", "bucket", F.col("term").asc_nulls_first(), "number")


class _Block:
    """Sums over words of how far the sources of block ``i`` differ from those of block ``j``."""

    def __init__(self, lang: str, i: int, j: int, p0: list[list[int]], sources: int, at_once: int):
        self.lang, self.i, self.j, self.sources, self.at_once = lang, i, j, sources, at_once
        self.p0 = [np.array(p0[0], np.int64), np.array(p0[-1], np.int64)]
        self.sums, self.words = np.zeros((len(self.p0[0]), len(self.p0[1])), np.int64), 0

    def add(self, word: np.ndarray, number: np.ndarray, p: np.ndarray) -> None:
        """Entries of whole words, numbered in ``word`` from 0."""
        n = int(word[-1]) + 1
        for at in range(0, n, self.at_once):
            a, b = np.searchsorted(word, [at, at + self.at_once])
            sides = []
            for block, p0 in zip((self.i, self.j), self.p0):
                here = number[a:b] // self.sources == block
                side = np.tile(p0, (min(n - at, self.at_once), 1))
                side[word[a:b][here] - at, number[a:b][here] % self.sources] = p[a:b][here]
                sides.append(side)
            for k in range(len(self.p0[0])):
                x = sides[0][:, k : k + 1]
                self.sums[k] += ((x - sides[1]) ** 2 // (x + sides[1])).sum(axis=0)
        self.words += n

    def rows(self, names: list[str]) -> pa.RecordBatch:
        a, b = np.meshgrid(np.arange(len(self.p0[0])), np.arange(len(self.p0[1])), indexing="ij")
        a, b = (a + self.i * self.sources).ravel(), (b + self.j * self.sources).ravel()
        once = np.flatnonzero(a < b)
        columns = [pa.array([self.lang] * len(once), pa.string()), pa.array(a[once].astype(np.int32)), pa.array(b[once].astype(np.int32))]
        columns += [pa.array(self.sums.ravel()[once]), pa.array(np.full(len(once), self.words, np.int64))]
        return pa.RecordBatch.from_arrays(columns, names)


def _block_sums(batches: Iterator[pa.RecordBatch], sources: int, at_once: int) -> Iterator[pa.RecordBatch]:
    names = ["lang", "a", "b", "value", "seen"]
    block: _Block | None = None
    held: list[pa.RecordBatch] = []

    def take(last: bool) -> None:
        """Give the held entries to the block; unless they are its last, those of the last word wait."""
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        term = rows.column("term").combine_chunks()
        new = np.ones(len(term), bool)
        new[1:] = np.asarray(term.slice(1).to_numpy(zero_copy_only=False) != term.slice(0, len(term) - 1).to_numpy(zero_copy_only=False))
        whole = len(term) if last else int(np.flatnonzero(new)[-1])
        if whole:
            number, p = (rows.column(c).to_numpy()[:whole] for c in ("number", "p"))
            block.add(np.cumsum(new[:whole]) - 1, number, p)
        if whole < len(term):
            held.extend(rows.slice(whole).to_batches())

    for batch in batches:
        entries = batch.select(["term", "number", "p"])
        heads = np.flatnonzero(np.asarray(batch.column("term").is_null()))
        at = 0
        for h in [*heads.tolist(), batch.num_rows]:
            if h > at:
                held.append(entries.slice(at, h - at))
            if h == batch.num_rows:
                take(False)
                break
            if block:
                take(True)
                yield block.rows(names)
            block = _Block(*(batch.column(c)[h].as_py() for c in ("lang", "i", "j", "p0")), sources, at_once)
            at = h + 1
    if block:
        take(True)
        yield block.rows(names)


def source_pairs(found: Shares, sources: int = SOURCES, at_once: int = WORDS) -> DataFrame:
    """lang, source, item, value for each source and other source of a language: the sum of f over all kept words, 0 without any."""
    spark = found.groups.sparkSession
    sums = _blocks(found, partitions(spark), sources).mapInArrow(lambda batches: _block_sums(batches, sources, at_once), "lang string, a int, b int, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = found.groups.select("lang", F.col("number").alias("a"), F.col("source").alias("x"), F.col("p0").alias("p"))
    two = found.groups.select("lang", F.col("number").alias("b"), F.col("source").alias("y"), F.col("p0").alias("q"), "v")
    # words that neither source has add as much each
    absent = F.when(F.col("v") > F.col("seen"), (F.col("v") - F.col("seen")) * _differ(F.col("p"), F.col("q"))).otherwise(0)
    both = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).withColumn("value", F.col("value") + absent)
    ways = F.inline(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return both.select("lang", ways, "value")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, sources: int = SOURCES, at_once: int = WORDS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` words that set the group off
    from its language; larger values rank first, ties by the item's bytes. Reads ``lang``, ``source`` and
    ``text`` only; nulls are empty strings, and each row is a document, whether or not its id or text repeats. A language
    with no kept word has pairs of value 0 and no terms; a single source has no pairs; an empty table has no rows.
    """
    found = shares(docs, min_docs)
    pairs = source_pairs(found, sources, at_once).select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    above = found.entries.filter(F.col("p") > F.col("q"))
    terms = above.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")).alias("rank")
    first = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first)
