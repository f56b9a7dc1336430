"""A Merkle tree over a dataset, its proofs, and their check.

Nodes of a tree are rows (tree, pos, hash). A level is pivoted by slots: conditional aggregates spread the children of each
parent into one column per slot; the concatenated columns hash to the parent, and without a slot's own column they
are that child's siblings. Going back down, each pivoted row hands its children what they need to climb, so no
row is joined with its ancestors one by one. Only digests are shuffled, never texts, and groups have at most
``FANOUT`` rows, so a source of any size spreads over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.scratch import partitions, stored

#: Children of a node, and the capital letters that tampering changes.
FANOUT = 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts after each other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of values: ``-`` for null, else the UTF-8 length, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def placed(rows: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, their place within ``tree`` by ``order``, and ``nodes``, the tree's rows.

    Rows are sorted over all tasks and written; a row's place is its place among its task's rows of the tree, and the counts
    of the tasks before. No tree is gathered in a task, and rows that agree in all of ``order`` need a column in it that does not.
    """
    spark = rows.sparkSession
    by = [F.col(tree), *[F.col(c) for c in order]]
    dealt = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    # the lower bits of the id count a task's rows, the upper ones tell the task
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("task", F.shiftright("at", 33))
    parts = dealt.groupBy(tree, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_tree = Window.partitionBy(tree)
    parts = parts.withColumn("before", F.sum("n").over(of_tree.orderBy("task")) - F.col("n")).withColumn("nodes", F.sum("n").over(of_tree))
    found = dealt.join(parts.drop("n"), [tree, "task"])
    return found.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "task", "first", "before")


@dataclass
class Trees:
    """``tops``: tree, hash, level of each tree's last node; ``levels``: for each level the pivoted rows tree, pos of the parent,
    nodes, and the slots' columns s0, s1 ..., each a struct with the child's hash."""

    tops: DataFrame
    levels: list[DataFrame] = field(default_factory=list)


def _slot(k: int) -> str:
    return f"s{k}"


def pivoted(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row per parent; a slot is the struct of its child's hash and what the child carries."""
    child = F.struct("hash", *carried)
    slots = [F.max(F.when(F.col("pos") % FANOUT == k, child)).alias(_slot(k)) for k in range(FANOUT)]
    return nodes.groupBy("tree", F.call_function("div", F.col("pos"), F.lit(FANOUT)).alias("pos"), "nodes").agg(*slots)


def _hashes(without: int | None = None) -> list[Column]:
    return [F.coalesce(F.col(_slot(k))["hash"], F.lit("")) for k in range(FANOUT) if k != without]


def build(leaves: DataFrame, carried: list[str], label: str) -> Trees:
    """Levels of the trees of ``leaves`` (tree, pos, nodes, hash, and what leaves carry)."""
    trees, nodes, level = Trees(leaves.filter("nodes = 1").select("tree", "hash", F.lit(0).alias("level"))), leaves, 0
    while True:
        left = nodes.filter("nodes > 1")
        level += 1
        found = stored(pivoted(left, carried if level == 1 else []), f"{label}-{level}")
        # the largest tree tells when to stop
        if found.agg(F.max("nodes")).first()[0] is None:
            return trees
        trees.levels.append(found)
        nodes = found.select("tree", "pos", F.ceil(F.col("nodes") / FANOUT).cast("long").alias("nodes"), digest(*_hashes()).alias("hash"))
        trees.tops = trees.tops.unionByName(nodes.filter("nodes = 1").select("tree", "hash", F.lit(level).alias("level")))


def descend(trees: Trees, tops: DataFrame, carried: list[str]) -> DataFrame:
    """Leaves with their ``path``: for each level upwards the siblings left and right of the climbing node.

    ``tops`` has tree, level, path (of the tree's last node, beyond the tree) and further columns that each leaf gets. Trees of
    a single leaf are left out.
    """
    extra = [c for c in tops.columns if c not in ("tree", "level", "path")]
    nodes = None
    for level in range(len(trees.levels), 0, -1):
        here = tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("pos"), "path", *extra)
        nodes = here if nodes is None else nodes.select("tree", "pos", "path", *extra).unionByName(here)
        rows = trees.levels[level - 1].join(nodes, ["tree", "pos"])
        children = []
        for k in range(FANOUT):
            step = F.struct(F.concat(F.lit(""), *_hashes()[:k]).alias("left"), F.concat(F.lit(""), *_hashes()[k + 1 :]).alias("right"))
            child = F.struct(
                (F.col("pos") * FANOUT + k).alias("pos"),
                F.concat(F.array(step), F.col("path")).alias("path"),
                F.col(_slot(k))["hash"].alias("hash"),
                *[F.col(_slot(k))[c].alias(c) for c in (carried if level == 1 else [])],
            )
            children.append(F.when(F.col(_slot(k)).isNotNull(), child))
        nodes = rows.select("tree", *extra, F.explode(F.array_compact(F.array(*children))).alias("child")).select("tree", *extra, "child.*")
    return nodes


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level upwards and left to right."""
    return digest(F.lit(""), F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def climb(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda at, s: digest(s["left"], at, s["right"]))


def manifest(rows: DataFrame, fields: list[str], tampered: dict[str, Column], when: Column, tree: str = "source", key: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A row's leaf is the digest of ``fields``. Where ``when`` holds, the row is checked with the ``tampered`` fields instead of its
    own. Within each ``tree`` leaves ascend by ``key``, null first, and rows that share it by their leaf. Null trees are a tree of their own,
    which comes first; a single leaf is its subroot, and a single subroot the root. Null and repeated keys, empty and long
    texts count as rows like others, other columns are not read, and an empty table gives no rows.
    """
    spark = rows.sparkSession
    own = leaf([F.col(c) for c in fields])
    other = leaf([tampered.get(c, F.col(c)) for c in fields])
    # a tree's name that sorts by bytes and keeps null, which comes first, apart from the empty text
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("."), F.col(tree).cast("string")))
    leaves = rows.select(name.alias("tree"), F.col(key).alias("key"), own.alias("hash"), F.when(when, other).alias("other"))
    # rows alike in all may take any of their places; a number lets them spread over tasks
    leaves = stored(leaves.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    leaves = placed(leaves, "tree", ["key", "hash", "nth"], "leaves-placed").drop("nth")
    carried = ["key", "other"]
    leaves = leaves.select("tree", "pos", "nodes", "hash", *carried)
    below = build(leaves, carried, "level")
    subroots = stored(below.tops.withColumn("all", F.lit("")), "subroots")
    top = placed(subroots.select("all", F.col("tree").alias("of"), "hash", "level"), "all", ["of"], "subroots-placed")
    top = top.select(F.col("all").alias("tree"), "pos", "nodes", "hash", "of", "level")
    above = build(top, ["of", "level"], "top")
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = above.tops.select("tree", "level", none.alias("path"), F.col("hash").alias("root"))
    # one source: its subroot is the root
    single = top.filter("nodes = 1").select(F.col("of").alias("tree"), "level", none.alias("path"), F.col("hash").alias("root"), F.col("hash").alias("subroot"))
    if above.levels:
        down = descend(above, tops, ["of", "level"])
        single = single.unionByName(down.select(F.col("of").alias("tree"), F.col("level"), "path", "root", F.col("hash").alias("subroot")))
    sources = stored(single, "source-paths")
    alone = leaves.filter("nodes = 1").join(sources.drop("level"), ["tree"]).select("key", "other", "hash", "path", "root", "subroot")
    found = alone
    if below.levels:
        found = alone.unionByName(descend(below, sources, carried).select("key", "other", "hash", "path", "root", "subroot"))
    folded = climb(F.coalesce("other", "hash"), F.col("path"))
    out = found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source. Where 5 divides the CRC-32 of the decimal doc_id, the text's
    capitals A-Z are made small before the check; rows without an id stay as they are."""
    every_fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = {"text": F.translate("text", CAPITALS, SMALL)}
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed, every_fifth)
