import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colscope.llm import mixing
from tests.llm.common import awkward, empty


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def test_mix_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    counts = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts}
    for r in rows:
        assert (r["doc_id"], r["size"]) in counts
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in targets(sizes).items():
        assert target[s] == pytest.approx(t)
        assert taken[s] == pytest.approx(t, abs=max(30, 0.02 * t))
        assert {r["source_size"] for r in rows if r["source"] == s} == {sizes[s]}
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_caps_are_shared_out(spark):
    for sizes in (
        {"a": 1, "b": 10, "c": 100_000, "d": 3, "e": 5_000, None: 70},
        {"a": 100, "b": 200, "c": 300, "d": 100, "e": 200, None: 300},  # ties
        {"a": 0, "b": 0}, {None: 5}, {"a": 0, "b": 7},
    ):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        for s, t in targets(sizes).items():
            assert got[s] == pytest.approx(t)


def test_highest_quotients_as_one_by_one(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 24.0, "d": 0.0, "e": 1000.0, "f": 3.5}
    for seats in (0, 1, 5, 37, 400):
        df = spark.createDataFrame([("g", k, v) for k, v in votes.items()], "g string, p string, v double")
        got = mixing.highest_quotients(df, F.col("v"), F.lit(seats), ["g"], [F.col("p")], "won").collect()
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
            won[best] += 1
        assert {r["p"]: r["won"] for r in got} == won


def test_texts_follow_the_mix(spark):
    docs = awkward(spark)
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    texts = mixing.mixed_texts(docs)
    assert set(texts.columns) == set(docs.columns) - {"size"}
    words = texts.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("t")).collect()
    assert {r["source"]: r["t"] for r in words if r["t"]} == {r["source"]: r["t"] for r in taken if r["t"]}


def test_no_rows(spark):
    assert mixing.mix(empty(spark)).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    df = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_texts_stay_whole(spark):
    texts = {i: "\n\n".join(f"s{i} w{k}  of\ttext" for k in range(5 + i % 17)) for i in range(300)}
    df = spark.createDataFrame([(i, "abc"[i % 3], t) for i, t in texts.items()], "doc_id long, source string, text string")
    rows = mixing.mixed_texts(df).collect()
    assert {r["source"] for r in rows} == {"a", "b", "c"}
    assert all(r["text"] in texts[r["doc_id"]] for r in rows)
    for s in "abc":  # the run of blocks cuts two documents of a shard at most
        assert sum(r["text"] != texts[r["doc_id"]] for r in rows if r["source"] == s) <= 2


def test_clashing_columns_pass_through(spark):
    names = ["shard", "start", "offset", "blocks", "repeats", "extra", "_kept", "_row", "_source", "_id", "_place", "a.b"]
    rows = [(i, f"w{i} " * (i % 7 + 1), "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(40)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(tuple(r)[3:] == rows[r["doc_id"]][3:] for r in found)
    kept = mixing.mix(docs, keep=["doc_id", "shard", "_place", "start"])
    assert kept.columns == ["doc_id", "shard", "_place", *mixing.RESULTS, *mixing.CHOICE]
    assert all((r["shard"], r["_place"]) == (f"shard{r['doc_id']}", f"_place{r['doc_id']}") for r in kept.collect())
