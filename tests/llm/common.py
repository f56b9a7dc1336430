"""A small table of documents with the awkward cases."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, rid string, spans string"


def awkward(spark, seed=3, n=60):
    """Nulls, empty and long texts, repeated rows and ids, copies, near copies, and columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(base)]
    for i in range(20):  # near copies and shared passages
        words = base[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "a"))
        rows.append((2000 + i, base[i] + "\n" + base[i + 20] + " tail", "fr", "b"))
    rows += [(3000, None, "en", "a"), (3001, "", "en", "a"), (3002, "  \t\n", None, None), (None, base[3], "en", "a"), (None, None, None, None)]
    rows += [rows[5], rows[5], (5, base[9], "en", "c"), (3003, " ".join(base * 12), "en", "b"), (3004, "x" * 5000, "en", "b"), (3005, "one", "en", "c"), (3006, "ONE", "en", "c")]
    rows = [(i, t, lang, s, len(t or ""), "s", "r", None) for i, t, lang, s in rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
