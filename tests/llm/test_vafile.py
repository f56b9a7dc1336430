import math
import random

import duckdb
from pyspark.sql import functions as F

from colscope.llm import queries, vafile
from tests.oracle import connect, difference

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score string"


def brute(rows, k, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(kept) if c != q and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_as_by_brute_force(spark):
    rng = random.Random(2)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(400, None), (410, [None] * 6), (420, [float("nan")] * 6), (430, [float("inf")] * 6), (None, [1.0] * 6), (440, []), (450, [1.0, 2.0]), (460, [1.0, -2.0])]
    rows += [rows[0], (10, [f32(0.25)] * 6)]
    df = spark.createDataFrame([(i, v, 0, "v", "s") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 10 == 0, 7).collect()))
    assert got == brute(rows, 7)


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    rows = vafile.top_k(df, F.col("vec_id") % 10 == 0).collect()
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [2, 1]


def test_large_components_are_whole(spark):
    # some scores pass 64 bits: they are ranked whole and returned as their end
    rows = [(0, [5e6, 3.0, 1e12]), (1, [5e6, 1.0, 0.0]), (2, [4e6, 2.0, 0.0]), (3, [5e6, 1.0 + 2**-10, 0.0]), (4, [-1e12 / 5, 7.0, 1e6]), (5, [-2e11, 8.0, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, i, max(min(s, 2**63 - 1), -(2**63))) for q, r, i, s in brute(rows, 10)]
    assert sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 10 == 0).collect())) == want


def test_many_equal_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "PRODUCT_CELLS", 50)
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(200)] + [(rng.randrange(400), [3.0, 3.0, 3.0]) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())) == brute(rows, 5)


def test_repeated_candidate_ids_as_by_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 130 + 1 if i else 100, [float(rng.gauss(0, 1)) for _ in range(4)]) for i in range(120)] + [(7, [1.0] * 4), (7, [1.0] * 4), (8, [2.0] * 4)]
    rows = [r for k, r in enumerate(rows) if r[0] != 100 or k == 0]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "op2_exact_top_k"
    assert difference(queries.QUERIES[name](spark, str(tmp_path)), con, queries.SQL[name]) is None


def test_no_vectors(spark):
    assert vafile.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_same_as_sql(spark, sf_dir):
    name = "op2_exact_top_k"
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None
