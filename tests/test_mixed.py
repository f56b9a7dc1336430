import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from colscope.operators import encode, mixed
from colscope.operators.aggregates import pair_counts
from colscope.operators.mixed import conditional_proba, mixed_distance, row_distance, significance, value_distance


def brute(data, cols):
    """Distances from the definition: the larger share summed over all values."""
    out = {}
    for i, c in enumerate(cols):
        for x, y in combinations(sorted({r[i] for r in data}), 2):
            total = 0.0
            for j in range(len(cols)):
                if j == i:
                    continue
                px, py = Counter(r[j] for r in data if r[i] == x), Counter(r[j] for r in data if r[i] == y)
                nx, ny = sum(px.values()), sum(py.values())
                total += sum(max(px[w] / nx, py[w] / ny) for w in {*px, *py})
            out[c, x, y] = total / (len(cols) - 1)
    return out


def distances(spark, data, cols):
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    out = value_distance(conditional_proba(pair_counts(df, cols)), len(cols)).collect()
    return {(r["column"], r["vx"], r["vy"]): (r["cooccurrence"], r["distance"]) for r in out}


def check(found, expected):
    assert set(found) == set(expected)
    for k, v in expected.items():
        assert found[k][0] == pytest.approx(v)
        assert found[k][1] == pytest.approx(v - 1)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(3)
    return [(str(rnd.randrange(5)), str(rnd.choice("xyz")), str(rnd.randrange(12))) for _ in range(150)]


def test_same_as_the_definition(spark, data):
    check(distances(spark, data, ["a", "b", "c"]), brute(data, ["a", "b", "c"]))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_slices_do_not_change_the_result(spark, data, monkeypatch, size):
    monkeypatch.setattr(mixed, "GROUP_SIZE", size)
    check(distances(spark, data, ["a", "b", "c"]), brute(data, ["a", "b", "c"]))


def test_extremes(spark):
    same = [(a, b) for a in "pq" for b in "xy"] * 3
    assert all(d == pytest.approx(0) for _, d in distances(spark, same, ["a", "b"]).values())
    apart = [("p", "x"), ("q", "y"), ("r", "z")]
    found = distances(spark, apart, ["a", "b"])
    assert len(found) == 6 and all(d == pytest.approx(1) for _, d in found.values())


def test_shares_add_up(spark, data):
    df = spark.createDataFrame(data, "a string, b string, c string")
    sums = defaultdict(float)
    for r in conditional_proba(pair_counts(df, ["a", "b", "c"])).collect():
        sums[r["ci"], r["cj"], r["vi"]] += r["p"]
    assert all(v == pytest.approx(1) for v in sums.values())


def test_significance_is_the_sum_of_distances(spark, data):
    df = spark.createDataFrame(data, "a string, b string, c string")
    proba = conditional_proba(pair_counts(df, ["a", "b", "c"]))
    expected = defaultdict(lambda: [0.0, 0.0])
    for (c, _, _), v in brute(data, ["a", "b", "c"]).items():
        expected[c][0] += (v - 1) / 45
        expected[c][1] += v / 45
    found = {r["column"]: [r["significance"], r["significance_raw"]] for r in significance(proba, 3).collect()}
    assert set(found) == set(expected)
    assert all(found[c] == pytest.approx(expected[c]) for c in found)


def test_mixed_distance(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("ab"), rnd.choice("xyz"), rnd.uniform(0, 9)) for _ in range(120)]
    df = spark.createDataFrame(data, "a string, b string, n double")
    df = encode.bucketize(encode.string_index(df, ["a", "b"]), ["n"])
    cols = ["a-index", "b-index", "n-bucketized"]
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    expected = brute(rows, cols)
    out = mixed_distance(df, cols[:2], cols[2:])
    found = {(r["column"], r["vx"], r["vy"]): r["cooccurrence"] for r in out.cooccurrences.collect()}
    assert found == pytest.approx({k: v for k, v in expected.items() if k[0] != "n-bucketized"})
    sig = out.significances.first()
    total = sum(v - 1 for k, v in expected.items() if k[0] == "n-bucketized")
    assert (sig["column"], sig["significance"]) == ("n-bucketized", pytest.approx(total / 45))
    out.release()


def test_arrays_count_by_shares(spark):
    rows = [(["a", "b"], "x"), (["a", "a", None], "y"), ([], "x"), (None, "y"), (["c"], None), (["b", "c", "a"], "x")]
    df = spark.createDataFrame(rows, "t array<string>, s string")
    got = {(r["ci"], r["vi"], r["vj"]): r["count"] for r in pair_counts(df, ["t", "s"]).collect()}
    want = {("a", "x"): 1 / 2 + 1 / 3, ("a", "y"): 1.0, ("b", "x"): 1 / 2 + 1 / 3, ("c", "x"): 1 / 3}
    assert got == pytest.approx({**{("t", *k): n for k, n in want.items()}, **{("s", k[1], k[0]): n for k, n in want.items()}})


def test_distances_of_rows_with_several_values(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, []), (4, ["c", "a"]), (5, ["z"])], "id int, t array<string>")
    far = spark.createDataFrame([("t", "a", "b", 0.4), ("t", "b", "c", 1.0), ("t", "a", "c", 0.5), ("u", "a", "b", 9.0)], "column string, vx string, vy string, distance double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 1), (1, 3), (1, 4), (1, 5), (5, 5)], "x int, y int")
    got = {(r["x"], r["y"]): r["distance"] for r in row_distance(df, "id", "t", pairs, far).collect()}
    assert len(got) == 7 and got[1, 3] is None and got[1, 5] is None and got[5, 5] == 0.0
    assert got[1, 2] == got[2, 1] == pytest.approx(0.2)
    assert got[1, 1] == pytest.approx(0.2)
    assert got[1, 4] == pytest.approx((0.5 + 0.0 + 1.0 + 0.4) / 4)


@pytest.mark.parametrize("n", [1, 4, 100])
def test_nearest_values_are_those_of_all_distances(spark, n, monkeypatch):
    monkeypatch.setattr(mixed, "GROUP_SIZE", 8)
    rnd = random.Random(6)
    data = [(f"a{min(29, int(rnd.expovariate(0.1)))}", rnd.choice("xyz"), f"w{rnd.randrange(40)}") for _ in range(300)]
    df = spark.createDataFrame([*data, ("lonely", "none", "nobody")], "a string, b string, c string")
    proba = conditional_proba(pair_counts(df, ["a", "b", "c"])).cache()
    every = defaultdict(list)
    for r in value_distance(proba, 3).collect():
        if r["distance"] < 1 - 1e-9:
            every[r["column"], r["vx"]].append((round(r["distance"], 8), r["vy"]))
            every[r["column"], r["vy"]].append((round(r["distance"], 8), r["vx"]))
    got = defaultdict(list)
    for r in sorted(mixed.nearest_values(proba, 3, n).collect(), key=lambda r: r["rank"]):
        got[r["column"], r["value"]].append((r["distance"], r["nearest"]))
    assert got.keys() == every.keys() and ("a", "lonely") not in got
    for key, found in got.items():
        want = sorted(every[key])[:n]
        assert [d for d, _ in found] == pytest.approx([d for d, _ in want], abs=1e-7)
        assert len({y for _, y in found}) == len(want)
    proba.unpersist()


@pytest.mark.parametrize("n", [2, 9])
def test_nearest_values_across_blocks(spark, n, monkeypatch):
    """Blocks of a few values, of which all pairs meet, name the same values as all distances do, ties included."""
    monkeypatch.setattr(mixed, "BLOCK_VALUES", 7)
    rnd = random.Random(3)
    df = spark.createDataFrame([(f"a{rnd.randrange(40)}", rnd.choice("xyz"), f"w{rnd.randrange(12)}") for _ in range(200)], "a string, b string, c string")
    proba = conditional_proba(pair_counts(df, ["a", "b", "c"])).where("ci = 'a'").cache()
    assert mixed._packed(proba).count() > 4
    every = defaultdict(list)
    for r in value_distance(proba, 3).collect():
        for x, y in ((r["vx"], r["vy"]), (r["vy"], r["vx"])):
            if r["distance"] < 1 - 1e-9:
                every[x].append((round(r["distance"], 8), y))
    got = defaultdict(list)
    for r in sorted(mixed.nearest_values(proba, 3, n).collect(), key=lambda r: r["rank"]):
        got[r["value"]].append((round(r["distance"], 8), r["nearest"]))
    assert got == {x: sorted(found)[:n] for x, found in every.items()}
    proba.unpersist()


def test_best_of_a_cell_in_small_steps(monkeypatch):
    """However few sums are held at a time, a cell finds the same; equal overlaps go to the smaller place."""
    rnd = np.random.default_rng(4)
    size = rnd.integers(1, 6, 30)
    f = np.concatenate([rnd.choice(9, k, False) for k in size])
    p = rnd.integers(1, 4, len(f)) / 8
    block = (size, f, p)
    want = mixed._best_of(block, block, 3, True)
    monkeypatch.setattr(mixed, "CELL", 50)
    got = mixed._best_of(block, block, 3, True)
    assert all((a == b).all() for a, b in zip(want, got))
    table = np.zeros((30, 9))
    table[np.repeat(np.arange(30), size), f] = p
    for x in range(30):
        low = np.minimum(table[x], table).sum(axis=1)
        best = sorted((-v, y) for y, v in enumerate(low) if y != x and v > 0)[:3]
        assert [(-v, y) for v, y in best] == [(v, y) for i, y, v in zip(*got) if i == x]


def test_blocks_are_shuffled_once_however_many_they_meet(spark, monkeypatch):
    """A block is not copied for each block that it meets: the join of blocks needs no more than one exchange of them."""
    monkeypatch.setattr(mixed, "BLOCK_VALUES", 7)
    df = spark.createDataFrame([(f"a{i % 60}", f"b{i % 7}", f"c{i % 11}") for i in range(500)], "a string, b string, c string")
    out = mixed.nearest_values(conditional_proba(pair_counts(df, ["a", "b", "c"])), 3, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "cogroup" not in plan.lower()
    assert plan.count("rangepartitioning(place") == 2  # the two sides, of which the second is the first's


@pytest.mark.parametrize("n", [1, 3, 40])
def test_both_sides_of_a_cell(n, monkeypatch):
    """One comparison of two blocks names the best for the values of either, in however small steps."""
    rnd = np.random.default_rng(5)

    def block(values):
        size = rnd.integers(0, 6, values)
        return size, np.concatenate([rnd.choice(12, k, False) for k in size]), rnd.integers(1, 4, size.sum()) / 8

    x, y = block(35), block(90)
    for cell, held in ((1 << 18, 1 << 20), (200, 30)):
        monkeypatch.setattr(mixed, "CELL", cell)
        monkeypatch.setattr(mixed, "HELD", held)
        mine, theirs = mixed._best_of_both(x, y, n, False)
        for got, one, other in ((mine, x, y), (theirs, y, x)):
            table = []
            for size, f, p in (one, other):
                table.append(np.zeros((len(size), 12)))
                table[-1][np.repeat(np.arange(len(size)), size), f] = p
            for k, row in enumerate(table[0]):
                low = np.minimum(row, table[1]).sum(axis=1)
                best = sorted((-v, j) for j, v in enumerate(low) if v > 0)[:n]
                assert [(-v, j) for v, j in best] == [(v, j) for i, j, v in zip(*got) if i == k]
