import hashlib
import random
from collections import Counter

import pytest

from colscope.llm import suffixes
from tests.llm.common import awkward, empty


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.cut(df).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(empty(spark)) == []


@pytest.mark.parametrize("seed", [4, 5])
def test_passages_cut_and_joined(spark, seed, monkeypatch):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde é\n") for _ in range(rng.randrange(900))) for _ in range(40)]
    rows = []
    for i in range(200):
        text = ""
        for _ in range(rng.randrange(5)):
            b = rng.choice(base)
            x = rng.randrange(len(b) + 1)
            text += b[x : x + rng.randrange(500)] + rng.choice(["", "Q"])
        rows.append((i, text))
    rows += [(1000, "ab" * 1500), (1001, "x" * 1000), (1002, " " * 199), (1003, "z" * 200), (1004, "w" * 201), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == brute(rows)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 20_000)  # many runs
    monkeypatch.setattr(suffixes, "COMPARED", 10)
    assert result(df) == brute(rows)


def test_remaining_text(spark):
    text = "é" * 150 + "unique middle " + "ü" * 150
    df = spark.createDataFrame([(1, text), (2, "a" + "é" * 150), (3, "ü" * 150)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffixes.cut(df, with_text=True).collect()}
    assert rows[1]["text"] == "unique middle " and rows[2]["text"] == "a" and rows[3]["text"] == ""


def test_loser_tree_sorts_and_knows_what_is_shared():
    rng = random.Random(3)
    for _ in range(100):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 7))]
        coded = [(r, suffixes.front_coded(r)) for r in runs]
        found = [(runs[run][k], share) for run, k, share in suffixes.merged(coded)]
        assert [s for s, _ in found] == sorted(s for r in runs for s in r)
        for (a, _), (b, share) in zip(found, found[1:]):
            assert share == suffixes.shared_prefix(a, b, 0)


def test_clashing_columns_pass_through(spark):
    names = ["rid", "of", "spans", "row", "kept", "s", "e", "n_removed", "a.b"]
    rows = [(i, "passage " * 40 + str(i), *[f"{c}{i}" for c in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = suffixes.cut(docs, with_text=True)
    others = [c for c in names if c != "n_removed"]
    assert out.columns == ["doc_id", *others, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    found = out.collect()
    assert len(found) == 12
    for r in found:
        assert [r[c] for c in others] == [f"{c}{r['doc_id']}" for c in others] and r["n_removed"] > 0
    spanned = suffixes.with_spans(docs)
    assert spanned.columns == ["doc_id", "text", *[c for c in names if c != "spans"], "spans"]
    assert all(r["spans"] and r["rid"] == f"rid{r['doc_id']}" for r in spanned.collect())
