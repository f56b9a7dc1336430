"""Language ID by unigrams of vocabulary pieces, with all segmentations of a word summed.

Words (runs of letters, lower-cased, with U+2581 in front) are scored by the forward algorithm: the
probability of a word is the sum, over every way to cut it into pieces of a public vocabulary, of the products
of the pieces' probabilities in a language. These come from expectation-maximisation over the word
counts of labelled texts. A text's score is the posterior of its best language, all being as likely beforehand.

Learned from at most about ``SAMPLE_DOCS`` texts of each language, chosen by a hash of their id; every text is
scored whole, and so is every run of letters, however long. A model holds a table of languages by pieces.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any text if nothing could be
learned; equal languages go to the first by code point; rows with a null or empty id are
not held out; repeated rows are scored each; other columns pass through and those named as a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.llm.quality import held_out
from colscope.llm.scratch import stored
from colscope.llm.words import steps, words

SAMPLE_DOCS = 4_000
ROUNDS = 3
#: Characters after which probabilities are divided anew, and characters, fillers included, of words segmented together.
STRIDE = 8
CELLS = 150_000
SMOOTHING = 0.05
#: Probability of a character that is no piece.
UNKNOWN = 1e-7
REMEMBERED = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of letters: ASCII letters and whatever is beyond ASCII.
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Pieces:
    """The vocabulary's lower-cased pieces by the hash of their characters; piece ``len(hashes)`` is no piece."""

    hashes: np.ndarray
    longest: int


def _char_values(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def _hash(s: str) -> int:
    h = 0
    for v in _char_values(np.array([ord(c) for c in s])).tolist():
        h = (h * int(_PRIME) + v) & (2**64 - 1)
    return h


def load_pieces(model: str) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    names = {p.id_to_piece(i).lower() for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    names = {s for s in names if all(c.isalpha() for c in s.removeprefix("▁"))}
    return Pieces(np.array(sorted(_hash(s) for s in names), np.uint64), max(map(len, names)))


def _spell(strings: list[str]) -> np.ndarray:
    """Code points of words, one row each, 0 where a word has ended."""
    n, width = len(strings), max(map(len, strings))
    out = np.zeros((n, width), np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    size = np.array([len(s) for s in strings])
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Segmenter:
    """Pieces at every place of a batch of words.

    Probabilities of long words are held in doubles by dividing what is open by its greatest value every ``STRIDE``
    characters; the logarithms of these divisors are kept, so a word may have any length.
    """

    def __init__(self, pieces: Pieces, strings: list[str]):
        code = _spell(strings)
        self.size = np.array([len(s) for s in strings])
        n, width = code.shape
        value = _char_values(code)
        ahead = np.zeros((n, width + 1), np.uint64)
        longest = min(pieces.longest, width)
        powers = np.cumprod(np.append(np.uint64(1), np.full(longest, _PRIME)))
        for i in range(width):
            ahead[:, i + 1] = ahead[:, i] * _PRIME + value[:, i]
        none = len(pieces.hashes)
        found = []
        for length in range(1, longest + 1):
            key = ahead[:, length:] - ahead[:, :-length] * powers[length]
            within = np.arange(width - length + 1) + length <= self.size[:, None]
            rows, at = np.nonzero(within)
            key = key[rows, at]
            k = np.searchsorted(pieces.hashes, key)
            k[k == none] = 0
            ok = pieces.hashes[k] == key
            if length == 1:  # a character is always a way on
                k, ok = np.where(ok, k, none), np.ones(len(k), bool)
            found.append((at[ok], np.full(int(ok.sum()), length), rows[ok], k[ok]))
        at, length, rows, k = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(at, kind="stable")
        self.width, self.longest = width, longest
        self.length, self.rows, self.k = length[order], rows[order], k[order]
        self.edges = np.searchsorted(at[order], np.arange(width + 1))

    def _from(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ends and pieces of what begins at place ``i``."""
        some = slice(self.edges[i], self.edges[i + 1])
        return self.rows[some], self.length[some] + i, self.k[some]

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[i]: words by languages, the probability of the first i characters over exp(logs[i // STRIDE]);
        p: pieces by languages."""
        alpha = np.zeros((self.width + 1, len(self.size), p.shape[1]))
        logs = np.zeros((self.width // STRIDE + 1, *alpha.shape[1:]))
        alpha[0] = 1
        for i in range(self.width + 1):
            if i and i % STRIDE == 0:
                open_ = alpha[i : i + self.longest]
                most = open_.max(axis=0)
                most[most == 0] = 1  # words that have ended
                open_ /= most
                logs[i // STRIDE] = logs[i // STRIDE - 1] + np.log(most)
            if i < self.width:
                rows, end, k = self._from(i)
                alpha[end, rows] += alpha[i, rows] * p[k]
        return alpha, logs

    def log_total(self, p: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each word in each language."""
        alpha, logs = self.forward(p)
        every = np.arange(len(self.size))
        return np.log(alpha[self.size, every]) + logs[self.size // STRIDE, every]

    def total(self, p: np.ndarray) -> np.ndarray:
        return np.exp(self.log_total(p))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; counts: of the words in each language."""
        alpha, logs = self.forward(p)
        every = np.arange(len(self.size))
        beta = np.zeros_like(alpha)  # over what alpha has been divided by, times counts and over the words' probability
        beta[self.size, every] = counts / alpha[self.size, every]
        out = np.zeros_like(p)
        for i in range(self.width - 1, -1, -1):
            rows, end, k = self._from(i)
            through = p[k] * beta[end, rows]
            later = end // STRIDE
            if later.max(initial=0) > i // STRIDE:
                through *= np.exp(logs[i // STRIDE, rows] - logs[later, rows])
            np.add.at(out, k, through * alpha[i, rows])
            np.add.at(beta[i], rows, through)
        return out


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of words in groups of similar sizes, none with more than ``CELLS`` characters and fillers but those of one word."""
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        # the last of a group is its longest
        step = max(1, CELLS // int(sizes[order[a]] + 2))
        b = min(len(order), a + step)
        while b > a + 1 and (b - a) * int(sizes[order[b - 1]] + 2) > CELLS:
            b = a + max(1, (b - a) // 2)
        yield order[a:b]
        a = b


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all runs of letters in (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = words(_lowered(b.column("text")), _APART)
            data, langs, found = w.data.tobytes(), b.column("lang").to_pylist(), Counter()
            for i, lang in enumerate(langs):
                found.update([(lang, data[w.start[k] : w.end[k]]) for k in range(w.first[i], w.first[i + 1])])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1].decode() for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    p: np.ndarray  # pieces (the last: no piece) by languages


def fit(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model | None:
    """A model of rows (doc_id, lang, text) that are not held out; None if there are none."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # languages are few: a model has a column for each
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 1_000_000.0 * sample_docs / n)])
    sample = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
    counts = stored(word_counts(sample), "lang-words")
    langs = sorted(sizes)
    pieces = load_pieces(vocabulary)
    p = np.full((len(pieces.hashes) + 1, len(langs)), 1.0 / len(pieces.hashes))
    column = {x: k for k, x in enumerate(langs)}
    for _ in range(rounds):
        p[-1] = UNKNOWN

        def expect(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            got = np.zeros_like(p)
            for b in batches:
                found = b.column("word").to_pylist()
                of = np.array([column[x] for x in b.column("lang").to_pylist()], np.int64)
                n = b.column("n").to_numpy()
                for some in _alike(np.array([len(w) for w in found], np.int64)):
                    by_lang = np.zeros((len(some), len(langs)))
                    by_lang[np.arange(len(some)), of[some]] = n[some]
                    got += Segmenter(pieces, ["▁" + found[j] for j in some]).expected(p, by_lang)
            k, lang = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(lang, pa.int32()), pa.array(got[k, lang])], ["k", "lang", "v"])

        summed = counts.select("lang", "word", "n").mapInArrow(expect, "k int, lang int, v double").groupBy("k", "lang").agg(F.sum("v").alias("v")).toPandas()
        p = np.full_like(p, SMOOTHING)
        p[summed["k"], summed["lang"]] += summed["v"]
        p /= p[:-1].sum(axis=0)
        p = np.maximum(p, 1e-9)  # so that no product of factors within a few strides is 0
    p[-1] = UNKNOWN
    return Model(langs, pieces, p)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages by pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, table, used = shared.value, {}, None, 0
        for b in steps(batches):
            texts = b.column("text")
            names, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if m is not None:
                w = words(_lowered(texts), _APART)
                h = w.hashes(False)
                unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                if table is None or used > REMEMBERED:
                    known, table, used = {}, np.zeros((1024, len(m.langs))), 0
                keys = unique.tolist()
                fresh = [k for k, x in enumerate(keys) if x not in known]
                data = w.data.tobytes()
                runs = [data[w.start[at[k]] : w.end[at[k]]].decode() for k in fresh]
                for group in _alike(np.array([len(r) for r in runs], np.int64)):
                    some = [fresh[j] for j in group]
                    value = Segmenter(m.pieces, ["▁" + runs[j] for j in group]).log_total(m.p)
                    while used + len(some) > len(table):
                        table = np.vstack([table, np.zeros_like(table)])
                    table[used : used + len(some)] = value
                    known.update((keys[k], used + j) for j, k in enumerate(some))
                    used += len(some)
                each = table[np.array([known[x] for x in keys], np.int64)[inverse]] if len(keys) else np.zeros((0, len(m.langs)))
                total = np.vstack([np.zeros((1, len(m.langs))), np.cumsum(each, axis=0)])
                total = total[w.first[1:]] - total[w.first[:-1]]
                best = total.argmax(axis=1)
                posterior = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
                letters = words(texts, _APART).count > 0
                for i in np.flatnonzero(letters):
                    s = texts[int(i)].as_py()
                    if s.isascii() or any(c.isalpha() for c in s):
                        names[i], scores[i] = m.langs[best[i]], posterior[i]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep if c != "text"], pa.array(names, pa.string()), pa.array(scores)], [*[c for c in keep if c != "text"], "lang_pred", "score"])

    rest = [c for c in keep if c != "text"]
    schema = T.StructType([docs.schema[c] for c in rest]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return docs.select(*rest, "text").mapInArrow(run, schema)
