"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a given share.

A set's n-grams are dealt to parts by their hash, two parts more than two linked sets can differ in; some
part of linked sets is then equal, and its hash is a key they share. Keys give candidate groups, which unlike
groups of one common n-gram hold few unrelated documents. Within them the links are found by a blocked sparse
matrix product: documents of a group by the n-grams that more than one of them has, counted block by
block, with pairs below the bound that their sizes set dropped. Equal sets are one row of the product.

Every link between different sets is kept: a block task gives a spanning forest of the links it finds, which
leaves components as they are. Groups of any size are cut into blocks of ``BLOCK_DOCS`` that meet only where their
sizes allow links, so that none is gathered whole.

Defined cases: a null text or one without words has an empty set and no links; fewer words than ``n`` are one
n-gram; rows that share an id are one node; a row without an id is a component without a name (null); equal texts
are linked; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.graph import components
from colscope.llm.runs import RUN_PAIRS, bucket_of, from_planes, pack_sorted, planes, unpack_sorted
from colscope.llm.scratch import partitions, stored
from colscope.llm.words import Words, mix, shingles, steps, words

#: Documents in a block of the product.
BLOCK_DOCS = 256
#: Columns of the product that are counted at once.
BLOCK_GRAMS = 1 << 13


class Bound:
    """Sizes and parts for similarity of at least ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.upper = [0]  # size class c holds sizes above upper[c-1] up to upper[c]

    def classes(self, n: np.ndarray) -> np.ndarray:
        """Linked sets are of one class or of neighbouring ones."""
        while len(n) and self.upper[-1] < n.max():
            self.upper.append((self.upper[-1] + 1) * 100 // self.percent)
        return np.searchsorted(np.array(self.upper), n)

    def parts(self, c: np.ndarray) -> np.ndarray:
        """Parts for the sets of class c and those of the class below: at least two are free of differences."""
        self.classes(np.array([self.upper[-1] + 1] if len(c) and c.max() >= len(self.upper) else []))
        return 2 * np.array(self.upper)[c] * (100 - self.percent) // (100 + self.percent) + 2

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, ascending within each, and where each text's begin."""
    h = w.hashes(True)
    s, at = shingles(w, h, n)
    row = w.row[at]
    count = w.count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the words as one
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            there = count[short] > k
            whole[there] = whole[there] * np.uint64(0xD6E8FEB86659FD93) + h[w.first[short[there]] + k]
        s, row = np.concatenate([s, mix(whole + count[short].astype(np.uint64))]), np.concatenate([row, short])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(count) + 1))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def part_keys(grams: np.ndarray, first: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every non-empty set's parts, in the instance of its class and of the next; and the set of each."""
    size = np.diff(first)
    keys, owners = [], []
    some = np.flatnonzero(size)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spread = mix(grams ^ np.uint64(0xA0761D6478BD642F))
    row = np.repeat(np.arange(len(size)), size)
    c = bound.classes(size)
    for step in (0, 1):
        p = bound.parts(c + step)
        part = ((grams >> np.uint64(32)) * p[row].astype(np.uint64)) >> np.uint64(32)  # ascends within a set
        begins = np.cumsum(np.where(size > 0, p, 0)) - np.where(size > 0, p, 0)
        slot = begins[row] + part.astype(np.int64)
        total = int(np.where(size > 0, p, 0).sum())
        cut = np.searchsorted(slot, np.arange(total + 1))
        owner = np.repeat(some, p[some])
        number = np.arange(total) - begins[owner]
        held = np.diff(cut)
        key = mix(_sums(spread, cut) + held.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + mix(((c[owner] + step).astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)))
        # two parts at least are equal, so a set with one empty part may leave it out
        empties = np.bincount(owner[held == 0], minlength=len(size))
        use = (held > 0) | (empties[owner] > 1)
        keys.append(key[use])
        owners.append(owner[use])
    return np.concatenate(keys), np.concatenate(owners)


def sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): sizes and two hashes of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            g, first = gram_sets(words(b.column("text")), n)
            one, two = _sums(mix(g + np.uint64(1)), first), _sums(mix(g ^ np.uint64(0x9E3779B97F4A7C15)), first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "n_shingles", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs sorted by (key, id): distinct keys with their smallest id; links of the others to it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    lead = np.repeat(ids[at], np.diff(np.append(at, len(keys))))
    other = lead != ids
    links = np.unique(np.column_stack([lead[other], ids[other]]), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[at], ids[at], links[:, 0], links[:, 1]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def candidate_links(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): each document that shares a part's key with others, and the smallest id of these.

    A task sends one id for each key; what it knows to share a key is linked there and then.
    """
    buckets = 4 * partitions(docs.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, held, pairs, seen = Bound(percent), [], 0, {}

        def flush():
            k, d = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.lexsort((d, k))
            k, d, a, b = _stars(k[order], d[order])
            bucket = bucket_of(k, buckets)
            of, at = np.unique(bucket, return_index=True)
            rows = {"bucket": [], "n": [], "links": [], "data": []}
            for i, (x, y) in enumerate(zip(at, np.append(at[1:], len(k)))):
                some = slice(i * len(a) // len(of), (i + 1) * len(a) // len(of))
                rows["bucket"].append(int(of[i]))
                rows["n"].append(int(y - x))
                rows["links"].append(some.stop - some.start)
                rows["data"].append(pack_sorted(k[x:y]) + planes(d[x:y]) + planes(a[some]) + planes(b[some]))
            return pa.RecordBatch.from_pydict(rows, schema=_PACKED)

        for batch in steps(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            g, first = gram_sets(words(batch.column("text")), n)
            k, owner = part_keys(g, first, bound)
            held.append((k, ids[owner]))
            pairs += len(k)
            if pairs >= RUN_PAIRS:
                yield flush()
                held, pairs = [], 0
        if pairs:
            yield flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d, links = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                m, e, data = row["n"], row["links"], row["data"]
                k.append(unpack_sorted(data[: 8 * m], m))
                d.append(from_planes(data[8 * m : 16 * m], np.int64, m))
                both = data[16 * m :]
                links.append(np.column_stack([from_planes(both[: 8 * e], np.int64, e), from_planes(both[8 * e :], np.int64, e)]))
        if not k:
            return
        k, d = np.concatenate(k), np.concatenate(d)
        order = np.lexsort((d, k))
        _, _, a, b = _stars(k[order], d[order])
        found = np.unique(np.concatenate([*links, np.column_stack([a, b])]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_LINKS)

    packed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    packed = packed.mapInArrow(keyed, "bucket int, n int, links int, data binary")
    return packed.repartition(partitions(docs.sparkSession), "bucket").mapInArrow(met, "a long, b long").distinct()


_PACKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("links", pa.int32()), ("data", pa.binary())])


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b between n nodes join two parts not joined before."""
    root, use = list(range(n)), np.zeros(len(a), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            use[k] = True
    return use


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Counts of shared n-grams: the product of two blocks of document rows, over columns both have."""
    lw, rw = np.concatenate(left), np.concatenate(right)
    lr, rr = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    columns = np.intersect1d(lw, rw)
    out = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(columns), BLOCK_GRAMS):
        some = columns[k : k + BLOCK_GRAMS]

        def block(grams: np.ndarray, rows: np.ndarray, n: int, some=some) -> np.ndarray:
            at = np.minimum(np.searchsorted(some, grams), len(some) - 1)
            ok = some[at] == grams
            m = np.zeros((n, len(some)), np.float32)
            m[rows[ok], at[ok]] = 1
            return m

        out += (block(lw, lr, len(left)) @ block(rw, rr, len(right)).T).astype(np.int64)
    return out


def _verified(bound: Bound):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id").reset_index(drop=True)
        ids = rows["doc_id"].to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        size = np.array([len(x) for x in grams])
        side = rows["side"].to_numpy()
        same = rows["same"].iloc[0]
        l, r = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(l) or not len(r):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        shared = overlaps([grams[i] for i in l], [grams[i] for i in r])
        i, j = np.nonzero(bound.linked(shared, size[l][:, None], size[r][None, :]) & (shared > 0))
        a, b = l[i], r[j]
        keep = a < b if same else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        use = _spanning(a, b, len(ids))
        return pd.DataFrame({"a": ids[a[use]], "b": ids[b[use]]})

    return run


def verified_links(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between the representatives ``nodes`` (doc_id, component, class)."""
    sizes = nodes.groupBy("component", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks"))
    above = sizes.select("component", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = sizes.select("component", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    placed = nodes.join(sizes, ["component", "class"]).join(above, ["component", "class"], "left").join(below, ["component", "class"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    c, mine = F.col("class"), F.col("block")
    task = lambda same, c1, b1, c2, b2, side: F.struct(F.lit(same).alias("same"), c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), side.alias("side"))
    own = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct((o == mine).alias("same"), c.alias("c1"), F.least(o, mine).alias("b1"), c.alias("c2"), F.greatest(o, mine).alias("b2"), (mine > o).cast("int").alias("side")),
    )
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda o: task(False, c, mine, c + 1, o, F.lit(0))))
    down = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda o: task(False, c - 1, o, c, mine, F.lit(1))))
    none = F.array().cast("array<struct<same:boolean,c1:int,b1:int,c2:int,b2:int,side:int>>")
    placed = placed.select(F.col("doc_id").alias("node"), "component", F.concat(own, F.coalesce(up, none), F.coalesce(down, none)).alias("tasks"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(placed, F.col("doc_id") == F.col("node"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            g, first = gram_sets(words(b.column("text")), n)
            grams = pa.array([g[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("component"), b.column("tasks"), grams], ["doc_id", "component", "tasks", "grams"])

    schema = "doc_id long, component long, tasks array<struct<same:boolean,c1:int,b1:int,c2:int,b2:int,side:int>>, grams binary"
    rows = texts.select("doc_id", "component", "tasks", "text").mapInArrow(gathered, schema)
    rows = rows.select("doc_id", "component", "grams", F.explode("tasks").alias("t")).select("doc_id", "component", "grams", "t.*")
    groups = rows.groupBy("component", "same", "c1", "b1", "c2", "b2")
    return groups.applyInPandas(_verified(Bound(percent)), "a long, b long")


def size_class(n: str, percent: int, most: int) -> F.Column:
    """The class of a size, as ``Bound.classes`` has it; ``most`` is the largest size."""
    bound = Bound(percent)
    bound.classes(np.array([most]))
    uppers = F.array(*[F.lit(x) for x in bound.upper])
    return F.size(F.filter(uppers, lambda u: u < F.col(n))).cast("int")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    known = stored(sets(docs, n), "jaccard-sets")
    most = known.agg(F.max("n_shingles")).first()[0] or 0
    full = known.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    first = full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("lead"))
    equal = full.join(first, ["n_shingles", "s1", "s2"]).filter(F.col("doc_id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    equal = stored(equal, "jaccard-equal")
    groups = components(candidate_links(docs, n, percent))
    leads = first.join(groups, F.col("lead") == F.col("node")).select(F.col("lead").alias("doc_id"), "component", size_class("n_shingles", percent, most).alias("class"))
    leads = stored(leads, "jaccard-leads")
    open_ = leads.groupBy("component").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("component")
    found = verified_links(docs, leads.join(open_, "component"), n, percent)
    final = components(equal.unionByName(found))
    named = known.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
