"""Quality rules as a short-circuit cascade (DataFrame operations only).

``measures`` works out the figures of every whole text; ``cascade`` estimates each rule's cost and how much
it rejects on a sample, orders the rules by rejection per cost, and evaluates them so that a text which one
rule rejects is spared the later ones. The verdict is the same in any order.

Defined cases: a null or empty text has no words; it fails the base rule. Lines are cut at ``\\n`` only.
Repeated rows count each by itself; an empty table gives no rows. Columns other than the ones named here
pass through ``cascade`` and ``measured``; one with the name of a result is replaced by it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Rows that cost and selectivity are estimated on, about.
SAMPLE_ROWS = 4_000

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once although ``body`` uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes. Only a text in which some window repeats sorts them
    with their places.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.transform(F.filter(s, lambda x, k: same(s, x, k, -1) | same(s, x, k, 1)), lambda x: x["i"]))

    def same(s: Column, x: Column, k: Column, step: int) -> Column:
        there = (k > 0) if step < 0 else (k < F.size(s) - 1)
        return F.when(there, F.get(s, k + step)["h"] == x["h"]).otherwise(F.lit(False))

    def covered(hashes: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(places(hashes)), start, step, lambda acc: acc["n"])

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) >= 3, counted).otherwise(F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep`` and its text) with ``FIGURES``."""
    keep = [c for c in (keep or docs.columns) if c not in FIGURES]
    text = F.coalesce(F.col("text"), F.lit(""))
    figures = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    out = docs.select(*keep, figures.alias("_w"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"))
    w = {c: F.col("_w")[c] for c in ("n_words", "word_chars", "n_repeat_words")}
    return out.withColumns(w).select(*keep, *FIGURES)


@dataclass(frozen=True)
class Rule:
    """A rule's name and when it rejects; ``rejects`` may be null, which does not reject."""

    name: str
    rejects: Column


def base_rule() -> Rule:
    return Rule("base", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def text_rules() -> list[Rule]:
    """Rules beside the base rule; the figures name the columns of ``measured``, the others read the text."""
    n = F.col("n_words")
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.size(F.split(text, "\n", -1))),
        Rule("repeated_words", 10 * F.col("n_repeat_words") > 3 * n),
        Rule("letters", 2 * letters < F.col("word_chars")),
        Rule("capitals", 2 * F.length(F.regexp_replace(text, r"\P{Lu}+", "")) > letters),
        Rule("shouted", 10 * F.regexp_count(text, F.lit(r"!")) > n),
        Rule("digits", 10 * F.regexp_count(text, F.lit(r"\p{Nd}")) > 3 * F.col("word_chars")),
    ]


def estimate(sample: DataFrame, rules: list[Rule], runs: int = 2) -> list[tuple[Rule, float, float]]:
    """(rule, share of the sample it rejects, seconds on the sample), best rejection per second first."""
    shares = sample.agg(*[F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(f"r{k}") for k, r in enumerate(rules)]).first()
    found = []
    for k, r in enumerate(rules):
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.agg(F.count(F.when(r.rejects, 1))).collect()
            took.append(time.perf_counter() - began)
        found.append((r, float(shares[k] or 0), min(took)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule], key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``, the first rule in estimated order that rejects it, or null.

    The sample takes rows by a hash of ``key`` and is stored once; figures it needs are in ``docs`` already.
    """
    total = docs.select(key).count()
    share = min(1.0, sample_rows / max(total, 1))
    bucket = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000))
    sample = stored(docs.filter(bucket < int(share * 1_000_000)), "rules-sample")
    verdict = F.lit(None).cast("string")
    for r, _, _ in reversed(estimate(sample, rules)):
        verdict = F.when(r.rejects, F.lit(r.name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict)


def judged(docs: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with its figures, ``base_failed``, ``rejected_by`` and ``kept``."""
    figures = measured(docs, docs.columns)
    first = base_rule()
    found = cascade(figures.withColumn("base_failed", first.rejects), text_rules(), key, sample_rows)
    found = found.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit(first.name)).otherwise(F.col("rejected_by")))
    return found.withColumn("kept", F.col("rejected_by").isNull())
