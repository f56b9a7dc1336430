"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The rule is the library's: a text becomes characters (spaces as U+2581, one more in front), and the adjacent
pair that forms the piece of the highest score is merged, the leftmost first, until no pair forms a piece; a
character without a piece becomes the ids of its bytes. Pieces hold U+2581 only in front (or alone), so no
merge crosses from one word to the next, and every word can be merged by itself.

Words of many texts are made unique and merged together: flat arrays of symbols, the smallest pair rank of
each word, all its leftmost occurrences at once, compaction, until no pair remains. Where such a merge would
form a pair that ranks as high as the merged one, only the first occurrence is merged in that round, which
keeps the order exact.

Defined cases: a null text counts as empty and gives the end id alone; texts of any length are encoded whole;
an empty table gives no rows; repeated rows are encoded each; other columns pass through, and one with the
name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colscope.llm.words import Words, steps, text_bytes

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Merged words that a task remembers.
REMEMBERED = 200_000
#: Symbols of a word with equally ranked pieces beyond which its merges run one by one.
LONG_TIE = 64


@dataclass
class Vocabulary:
    """What encoding needs of a model: ids and bytes of pieces, and the ranks of the pairs that form them."""

    symbol: np.ndarray  # of each code point, or -1
    left_right: np.ndarray  # sorted keys of pairs
    merged: np.ndarray
    rank: np.ndarray  # of the pair's piece, best first; equal scores share one
    tied: set[int]  # ranks that more than one piece has
    byte_ids: np.ndarray
    id_of: np.ndarray  # id of a symbol, or -1 for a character that is part of pieces only
    char_of: dict[int, str]
    surface: list[bytes]  # what an id decodes to
    end_id: int
    alone: np.ndarray  # ASCII bytes that no longer piece holds


def load(model: str) -> Vocabulary:
    """Read a model file's pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    normal, byte_ids, surface = {}, np.full(256, p.unk_id(), np.int32), [b""] * n
    for i in range(n):
        s = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(s[3:5], 16)] = i
            surface[i] = bytes([int(s[3:5], 16)])
        elif p.is_unknown(i):
            surface[i] = " ⁇ ".encode()
        elif not p.is_control(i) and not p.is_unused(i):
            normal[s] = i
            surface[i] = s.replace(SPACE, " ").encode()
    chars = sorted({c for s in normal for c in s} - set(normal))
    ids = dict(normal) | {c: n + k for k, c in enumerate(chars)}
    scores = {i: p.get_score(i) for i in normal.values()}
    order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    keys, merged = [], []
    for s, i in normal.items():
        for k in range(1, len(s)):
            a, b = ids.get(s[:k]), ids.get(s[k:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                merged.append(i)
    by = np.argsort(np.array(keys, np.int64))
    merged = np.array(merged, np.int32)[by]
    held = [order[v] for v in scores.values()]
    seen, tied = set(), set()
    for r in held:
        (tied if r in seen else seen).add(r)
    symbol = np.full(0x110000, -1, np.int32)
    for s, i in ids.items():
        if len(s) == 1:
            symbol[ord(s)] = i
    alone = np.ones(256, bool)
    alone[128:] = False
    for s in normal:
        if len(s) > 1:
            alone[[ord(c) for c in s if ord(c) < 128]] = False
    alone[32] = False
    return Vocabulary(
        symbol, np.array(keys, np.int64)[by], merged, np.array([order[scores[i]] for i in merged], np.int32), tied, byte_ids,
        np.concatenate([np.arange(n), np.full(len(chars), -1)]).astype(np.int32), {n + k: c for k, c in enumerate(chars)}, surface, p.eos_id(), alone,
    )


def _pairs(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if no piece) and merged symbol of each pair; symbols below 0 form none."""
    key = a.astype(np.int64) << 32 | b
    at = np.searchsorted(v.left_right, key)
    at[at == len(v.left_right)] = 0
    ok = (v.left_right[at] == key) & (a >= 0) & (b >= 0)
    return np.where(ok, v.rank[at], NONE).astype(np.int32), v.merged[at]


def merge_one_by_one(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The same rule with a queue, for words whose pieces tie and for tests."""
    sym, nxt, prv = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    alive, n, queue = [True] * len(symbols), len(symbols), []

    def offer(i: int) -> None:
        j = nxt[i]
        if i < 0 or j >= n or sym[i] < 0 or sym[j] < 0:
            return
        key = sym[i] << 32 | sym[j]
        at = int(np.searchsorted(v.left_right, key))
        if at < len(v.left_right) and v.left_right[at] == key:
            heapq.heappush(queue, (int(v.rank[at]), i, j, sym[i], sym[j], int(v.merged[at])))

    for i in range(n):
        offer(i)
    while queue:
        _, i, j, a, b, m = heapq.heappop(queue)
        if not (alive[i] and j < n and alive[j] and nxt[i] == j and sym[i] == a and sym[j] == b):
            continue
        sym[i], alive[j], nxt[i] = m, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [s for s, ok in zip(sym, alive) if ok]


def merge_rounds(v: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words, and the word each belongs to; ``word`` ascends."""
    done_sym, done_word = [], []

    def all_ranks(s, w):
        r, m = np.full(len(s), NONE, np.int32), np.zeros(len(s), np.int32)
        if len(s) > 1:
            r[:-1], m[:-1] = _pairs(v, s[:-1], s[1:])
            r[:-1][w[:-1] != w[1:]] = NONE
        return r, m

    rank, merged = all_ranks(sym, word)
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(sym)))
        least = np.minimum.reduceat(rank, first)
        over = least == NONE
        for k in np.flatnonzero(np.isin(least, list(v.tied)) & (size > LONG_TIE)):
            at = slice(first[k], first[k] + size[k])
            out = merge_one_by_one(v, sym[at].tolist())
            done_sym.append(np.array(out, sym.dtype))
            done_word.append(np.full(len(out), word[first[k]]))
            rank[at], over[k] = NONE, True
            word[at] = -1  # already given out
        if over.any():
            gone = np.repeat(over, size)
            given = gone & (word >= 0)
            done_sym.append(sym[given])
            done_word.append(word[given])
            stay = ~gone
            sym, word, rank, merged, least, size = sym[stay], word[stay], rank[stay], merged[stay], least[~over], size[~over]
            if not len(sym):
                break
            first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(first)), size)
        hit = rank == least[of]
        # of overlapping occurrences every second one, from the left
        place = np.arange(len(hit))
        begins = hit & ~np.concatenate([[False], hit[:-1]])
        run = np.maximum.accumulate(np.where(begins, place, 0))
        chosen = hit & ((place - run) % 2 == 0)
        while True:
            s, keep = sym.copy(), np.ones(len(sym), bool)
            at = np.flatnonzero(chosen)
            s[at] = merged[at]
            keep[at + 1] = False
            r2, m2, left = rank.copy(), merged.copy(), np.flatnonzero(keep)
            new = chosen[left]  # merged symbols, and those before them, form new pairs
            again = np.flatnonzero(new | np.append(new[1:], False))
            s2, w2 = s[left], word[left]
            r2, m2 = r2[left], m2[left]
            ok = again < len(left) - 1
            r2[again], a = NONE, again[ok]
            r, m = _pairs(v, s2[a], s2[a + 1])
            r[w2[a] != w2[a + 1]] = NONE
            r2[a], m2[a] = r, m
            bad = np.zeros(len(first), bool)
            bad[of[left[a][r <= least[of[left[a]]]]]] = True
            if not bad.any():
                break
            only = np.zeros(len(sym), bool)
            hits = np.flatnonzero(chosen)
            one = hits[np.concatenate([[True], of[hits][1:] != of[hits][:-1]])]
            only[one] = True
            trimmed = chosen & (only | ~bad[of])
            if (trimmed == chosen).all():
                break
            chosen = trimmed
        sym, word, rank, merged = s2, w2, r2, m2
    s, w = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
    by = np.argsort(w, kind="stable")
    return s[by], w[by]


def segments(texts: pa.Array, v: Vocabulary) -> Words:
    """Words with the spaces before them; characters that no longer piece holds stand alone."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
    front = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, ends = text_bytes(pc.binary_join_element_wise(front, texts, pa.scalar("", pa.large_string())))
    space, alone = data == 32, v.alone[data]
    start = space | alone
    if len(data):
        before = np.concatenate([[False], space[:-1]])
        start &= ~(space & before)
        start[1:] |= alone[:-1] & ~alone[1:]
        start[ends[:-1][np.diff(ends) > 0]] = True
    start = np.flatnonzero(start)
    end = np.append(start[1:], len(data)) if len(start) else start
    return Words(data, ends, start, end, np.searchsorted(start, ends))


class Encoder:
    """Encodes slices of texts; remembers the words it has merged."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        self.decimal = [str(i).encode() for i in range(len(v.surface))]

    def learn(self, strings: list[str]) -> list[tuple[bytes, int, bytes, np.ndarray]]:
        """For each word: its ids in decimal, how many, what they decode to, and the ids."""
        v = self.v
        code = np.frombuffer("".join(strings).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        sym = v.symbol[code].astype(np.int64)
        sym = np.where(sym < 0, -code - 1, sym)
        sym, word = merge_rounds(v, sym, word)
        cut = np.searchsorted(word, np.arange(len(strings) + 1))
        plain = sym >= 0
        ids = np.where(plain, v.id_of[np.where(plain, sym, 0)], -1)
        out = []
        for k in range(len(strings)):
            part = ids[cut[k] : cut[k + 1]]
            if (part < 0).any():
                spelled = []
                for s, i in zip(sym[cut[k] : cut[k + 1]].tolist(), part.tolist()):
                    spelled += [i] if i >= 0 else v.byte_ids[list((chr(-s - 1) if s < 0 else v.char_of[s]).encode())].tolist()
                part = np.array(spelled, np.int32)
            listed = part.tolist()
            out.append((b" ".join([self.decimal[i] for i in listed]), len(listed), b"".join([v.surface[i] for i in listed]), part.astype(np.int32)))
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[list, int]]:
        """For each text the remembered entries of its words, and their number of ids."""
        w = segments(texts, self.v)
        h = w.hashes(False)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        keys = unique.tolist()
        fresh = [k for k, x in enumerate(keys) if x not in known]
        data = w.data.tobytes()
        found = self.learn([data[w.start[at[k]] : w.end[at[k]]].decode() for k in fresh]) if fresh else []
        known.update(zip([keys[k] for k in fresh], found))
        entries = [known[x] for x in keys]
        counts = np.array([e[1] for e in entries], np.int64)[inverse] if len(keys) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        inverse = inverse.tolist()
        for i in range(len(w.first) - 1):
            a, b = w.first[i], w.first[i + 1]
            yield [entries[k] for k in inverse[a:b]], int(total[b] - total[a])


def decode(v: Vocabulary, ids: list[int]) -> str:
    """Text of ids: pieces joined, U+2581 as spaces, the one in front taken off, bytes read as UTF-8."""
    return b"".join([v.surface[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """The columns of ``docs`` but its text, with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if
    asked for, ``ids``; an end id closes every text."""
    v = load(model)
    results = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    keep = [c for c in docs.columns if c not in results and c != "text"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    shared = docs.sparkSession.sparkContext.broadcast(v)  # of the size of the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        end = shared.value.end_id
        tail = str(end).encode()
        for b in steps(batches):
            n, ids_hash, text_hash, ids = [], [], [], []
            for entries, count in encoder.encode(b.column("text")):
                n.append(count + 1)
                ids_hash.append(hashlib.sha256(b" ".join([e[0] for e in entries] + [tail])).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([e[2] for e in entries]).removeprefix(b" ")).hexdigest())
                if with_ids:
                    ids.append(np.concatenate([e[3] for e in entries] + [np.array([end], np.int32)]))
            columns = [b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, "text").mapInArrow(run, schema)
