import random

import pytest

from colscope.operators import clusters, encode
from colscope.operators.clusters import fit_mixed_clusters


@pytest.fixture(scope="module")
def encoded(spark):
    rnd = random.Random(11)
    data = []
    for i in range(150):
        g = i % 3
        data.append(("abc"[g] if rnd.random() < 0.9 else "a", rnd.choice("xy") if g else "x", g * 10 + rnd.random()))
    df = spark.createDataFrame(data, "a string, b string, n double")
    return encode.bucketize(encode.string_index(df, ["a", "b"]), ["n"]).cache()


def distance(model, centre, row, lo, hi):
    x = (row["n"] - lo) / (hi - lo)
    total = (model.weights[0] * (x - centre.means[0])) ** 2
    for i, c in enumerate(model.quali):
        v = int(row[c])
        total += sum(s * model.tables[i][v][w] for w, s in enumerate(centre.shares[i])) ** 2
    return total


def test_a_fitted_model_is_a_fixed_point(encoded):
    model = fit_mixed_clusters(encoded, ["a-index", "b-index"], ["n"], max_rounds=50)
    assert len(model.centres) == 3 and model.rounds < 50 and model.converged
    rows = model.assign(encoded).collect()
    lo, hi = model.bounds["n"]
    members = {}
    for r in rows:
        far = [distance(model, c, r, lo, hi) for c in model.centres]
        assert far[r["cluster"]] == pytest.approx(min(far), abs=1e-12)
        assert r["cluster_distance"] == pytest.approx(min(far), abs=1e-12)
        members.setdefault(r["cluster"], []).append(r)
    for k, group in members.items():
        centre = model.centres[k]
        assert centre.means[0] == pytest.approx(sum((r["n"] - lo) / (hi - lo) for r in group) / len(group))
        for i, c in enumerate(model.quali):
            for v, share in enumerate(centre.shares[i]):
                assert share == pytest.approx(sum(int(r[c]) == v for r in group) / len(group))


def test_same_seed_same_clusters(encoded):
    a = fit_mixed_clusters(encoded, ["a-index", "b-index"], ["n"])
    b = fit_mixed_clusters(encoded.repartition(5), ["a-index", "b-index"], ["n"])
    flat = [[x for c in m.centres for x in (*c.means, *[s for t in c.shares for s in t])] for m in (a, b)]
    assert flat[0] == pytest.approx(flat[1])


def test_counting_by_tuples_agrees(encoded, monkeypatch):
    a = fit_mixed_clusters(encoded, ["a-index", "b-index"], ["n"])
    monkeypatch.setattr(clusters, "TUPLE_LIMIT", 0)
    b = fit_mixed_clusters(encoded, ["a-index", "b-index"], ["n"])
    assert [c.means for c in a.centres] == [pytest.approx(c.means) for c in b.centres]
    assert [c.shares for c in a.centres] == [tuple(pytest.approx(s) for s in c.shares) for c in b.centres]


def test_needs_labels_and_bins(encoded):
    with pytest.raises(ValueError):
        fit_mixed_clusters(encoded.drop("n-bucketized"), ["a-index"], ["n"])
    with pytest.raises(ValueError):
        fit_mixed_clusters(encoded, ["n"], ["n"])


def test_costs_are_those_of_the_value_distances(encoded):
    model = fit_mixed_clusters(encoded, ["a-index", "b-index"], ["n"], max_rounds=2)
    costs = {(r["position"], int(r["value"])): r for r in model.costs.collect()}
    for i, table in enumerate(model.tables):
        for v, row in enumerate(table):
            for c, centre in enumerate(model.centres):
                want = sum(s * d for s, d in zip(centre.shares[i], row)) ** 2
                assert costs[i, v][f"c{c}"] == pytest.approx(want, abs=1e-12)


def test_five_thousand_values(spark):
    """Far more values than a table of their pairs could hold; half of them are frequent."""
    rows = [(f"w{c}", "pq"[c % 2], c % 2 + i % 7 / 100) for i in range(20_000) for c in [i % 5000 if i % 4 or i < 5000 else i % 2500]]
    df = spark.createDataFrame(rows, "w string, s string, n double")
    df = encode.bucketize(encode.index_by_join(df, ["w", "s"]), ["n"])
    model = fit_mixed_clusters(df, ["w-index", "s-index"], ["n"], k=2)
    assert model.sizes == [5000, 2] and model.converged
    assert model.costs.where("position = 0").count() == 5000
    # what a value stands for decides its cluster, and the shares are those of the rows
    out = model.assign(df).cache()
    assert out.select("s", "cluster").distinct().count() == 2
    n = {r["cluster"]: r["count"] for r in out.groupBy("cluster").count().collect()}
    want = {(r["w-index"], r["cluster"]): r["count"] / n[r["cluster"]] for r in out.groupBy("w-index", "cluster").count().collect()}
    got = {(r["value"], r["cluster"]): r["share"] for r in model.shares.where("position = 0").collect()}
    assert got == pytest.approx(want)
    out.unpersist()
