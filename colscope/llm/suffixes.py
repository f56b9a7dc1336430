"""Suffix-array deduplication: bytes covered by strings of ``length`` bytes that occur more than once.

Only some suffixes are sorted. In every window of ``length`` bytes the position of the smallest hash of ``GRAM``
bytes is its anchor; equal strings have their anchor in the same place. Where the anchor's bytes occur nowhere
else, the strings of its windows cannot either, so those suffixes are left out after one exchange of
hashes. Each remaining suffix carries what its windows reach to its right and, reversed, to its left.

Tasks sort their suffixes and send front-coded runs (length of the prefix shared with the suffix before, and the
rest). Loser trees combine the runs; they keep the prefix a candidate is known to share with the last output and
compare beyond it only. In the sorted order, suffixes that share the anchor's bytes are
neighbours, and their windows are compared place by place. Suffixes that are equal in a task's run are known as repeated there, and one of them is sent.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing; matches never cross
texts; a match may be in the same text, and overlap itself; repeated rows remove each other; an empty
table gives no rows. Other columns pass through; one with the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.columns import ref
from colscope.llm.runs import RUN_PAIRS, bucket_of, from_planes, pack_sorted, planes, unpack_sorted
from colscope.llm.scratch import partitions
from colscope.llm.words import mix, steps, text_bytes

LENGTH = 200
GRAM = 64
#: Bytes of suffixes that a task gathers before it sorts them and sends them on.
RUN_BYTES = 24 << 20
#: Suffixes whose windows are compared together; a group of equal anchors is never cut.
COMPARED = 20_000

_P = 0x9E3779B97F4A7C15
#: Anchors have small hashes; mixed once more they are even keys.
_SPREAD = np.uint64(0x8EBC6AF09C88C6E3)
_PI = pow(_P, -1, 1 << 64)
_T = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


class Hasher:
    """Hashes of all runs of GRAM bytes; keeps its tables of powers between slices."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_P, n), _powers(_PI, n)
        s = np.concatenate([[np.uint64(0)], np.cumsum(_T[data] * self.up[:n], dtype=np.uint64)])
        return mix((s[GRAM:] - s[:-GRAM]) * self.down[: n - GRAM + 1])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[s:s+w] for every s."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(hasher: Hasher, data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, farthest, nearest, key): anchors, how far before them their windows start, and the
    hash of the bytes that begin there. Positions are in ``data``."""
    none = np.zeros(0, np.int64)
    size = np.diff(ends)
    if not (size >= length).any():
        return none, none, none, none, np.zeros(0, np.uint64)
    h = hasher.grams(data)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least = (_window_min(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.flatnonzero(size >= length)
    count = size[row] - length + 1
    start = np.repeat(ends[row], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    of = least[start]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(of)) - 1
    rows = np.repeat(row, count)[at]
    return rows, of[at], of[at] - start[at], of[at] - start[last], mix(h[of[at]] ^ _SPREAD)


def _grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ascending ids, and where each begins."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[at], np.append(at, len(ids))


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(rid, keys): the hashes at anchors of a text that occur at another anchor too."""
    buckets = 4 * partitions(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("known", pa.int32()), ("data", pa.binary())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, pairs = Hasher(), [], 0

        def flush():
            k, d = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(k, kind="stable")
            k, d = k[order], d[order]
            same = np.zeros(len(k), bool)
            same[1:] = k[1:] == k[:-1]
            twice = same.copy()
            twice[:-1] |= same[1:]
            k1, d1, known = k[~same], d[~same], twice[~same]
            k2, d2 = k[twice], d[twice]
            bucket = bucket_of(k1, buckets)
            of, cut = _grouped(bucket)
            # what is known here goes along with its bucket, to be answered from there
            cut2 = np.searchsorted(bucket_of(k2, buckets), np.append(of, buckets))
            rows = {"bucket": of.tolist(), "n": [], "known": [], "data": []}
            for i in range(len(of)):
                a, b, x, y = cut[i], cut[i + 1], cut2[i], cut2[i + 1]
                rows["n"].append(int(b - a))
                rows["known"].append(int(y - x))
                rows["data"].append(pack_sorted(k1[a:b]) + planes(d1[a:b]) + known[a:b].tobytes() + pack_sorted(k2[x:y]) + planes(d2[x:y]))
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for b in steps(batches):
            data, ends = text_bytes(b.column("text"))
            rows, _, _, _, key = anchors(hasher, data, ends, length)
            held.append((key, b.column("rid").to_numpy()[rows]))
            pairs += len(key)
            if pairs >= RUN_PAIRS:
                yield flush()
                held, pairs = [], 0
        if pairs:
            yield flush()

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d, known, k2, d2 = [], [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                n, m, data = r["n"], r["known"], r["data"]
                k.append(unpack_sorted(data[: 8 * n], n))
                d.append(from_planes(data[8 * n : 16 * n], np.int64, n))
                known.append(np.frombuffer(data, bool, n, 16 * n))
                rest = data[17 * n :]
                k2.append(unpack_sorted(rest[: 8 * m], m))
                d2.append(from_planes(rest[8 * m :], np.int64, m))
        if not k:
            return
        k, d, known = np.concatenate(k), np.concatenate(d), np.concatenate(known)
        order = np.argsort(k, kind="stable")
        k, d, known = k[order], d[order], known[order]
        twice = np.zeros(len(k), bool)
        twice[1:] = k[1:] == k[:-1]
        twice[:-1] |= twice[1:]
        use = twice & ~known
        k, d = np.concatenate([k[use], *k2]), np.concatenate([d[use], *d2])
        order = np.argsort(d, kind="stable")
        k, d = k[order], d[order]
        ids, cut = _grouped(d)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([k[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["rid", "keys"])

    packed = docs.select("rid", "text").mapInArrow(sent, "bucket int, n int, known int, data binary")
    return packed.repartition(partitions(docs.sparkSession), "bucket").mapInArrow(answered, "rid long, keys binary")


def shared_prefix(a: bytes, b: bytes, start: int) -> int:
    """How many first bytes are equal; the first ``start`` are known to be."""
    n, i = min(len(a), len(b)), start
    while i < n and a[i : i + 24] == b[i : i + 24]:
        i += 24
    while i < n and a[i] == b[i]:
        i += 1
    return min(i, n)


def front_coded(strings: list[bytes]) -> list[int]:
    """For sorted strings: bytes shared with the one before."""
    return [0, *[shared_prefix(a, b, 0) for a, b in zip(strings, strings[1:])]] if strings else []


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place, bytes shared with the output before) of sorted front-coded runs, in sorted order.

    A loser tree: a candidate keeps how much it shares with the last output. Of two candidates the one that
    shares more comes first; only at equal lengths are bytes compared, from there on.
    """
    runs = [r for r in runs]
    size = 1
    while size < len(runs):
        size *= 2
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    shares = [r[1] for r in runs]
    place = [0] * size
    lose, known = [-1] * size, [0] * size  # of each node: the run that lost there, and what it shares

    def beats(a: int, sa: int, b: int, sb: int) -> tuple[bool, int]:
        """Whether a comes before b, and what the loser shares with the winner."""
        if place[a] >= len(strings[a]):
            return False, 0
        if place[b] >= len(strings[b]):
            return True, 0
        if sa != sb:
            return sa > sb, min(sa, sb)
        x, y = strings[a][place[a]], strings[b][place[b]]
        s = shared_prefix(x, y, sa)
        if s == len(x):
            return (s < len(y) or a < b), s
        return (s < len(y) and x[s] < y[s]), s

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        (a, sa), (b, sb) = build(2 * node), build(2 * node + 1)
        first, s = beats(a, sa, b, sb)
        lose[node], known[node] = (b, s) if first else (a, s)
        return (a, sa) if first else (b, sb)

    win, s = build(1)
    while place[win] < len(strings[win]):
        yield win, place[win], s
        place[win] += 1
        s = shares[win][place[win]] if place[win] < len(strings[win]) else 0
        node = (win + size) // 2
        while node:
            first, lost = beats(win, s, lose[node], known[node])
            if first:
                known[node] = lost
            else:
                win, lose[node] = lose[node], win
                s, known[node] = known[node], lost
            node //= 2


_HEAD = [("share", np.uint8), ("rest", np.uint8), ("left", np.uint8), ("far", np.uint8), ("near", np.uint8), ("many", np.uint8), ("rid", np.int64), ("at", np.int32)]


def _spread(runs_: list[tuple[int, int, int]]) -> pa.RecordBatch:
    x = np.array(runs_, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2].astype(np.int32))], ["rid", "s", "e"])


def _pack_run(records: list[tuple], bucket: int, known: list[tuple[int, int, int]]) -> dict:
    """Front-code sorted records (right, left, far, near, many, rid, at); ``known`` spans go along."""
    right = [r[0] for r in records]
    share = front_coded(right)
    columns = [share, [len(r) - s for r, s in zip(right, share)], [len(r[1]) for r in records], *[[r[k] for r in records] for k in (2, 3, 4, 5, 6)]]
    head = b"".join(planes(np.array(c, t)) for c, (_, t) in zip(columns, _HEAD))
    spans = np.array(known, np.int64).reshape(-1, 3)
    body = b"".join([r[s:] for r, s in zip(right, share)]) + b"".join([r[1] for r in records])
    data = head + planes(spans[:, 0]) + planes(spans[:, 1].astype(np.int32)) + planes(spans[:, 2].astype(np.int32)) + body
    return {"bucket": bucket, "n": len(records), "known": len(known), "size": len(data), "data": pa.compress(data, codec="zstd", asbytes=True)}


def _unpack_run(r: dict) -> tuple[list[bytes], list[int], list[tuple], np.ndarray]:
    n, m, data = r["n"], r["known"], pa.decompress(r["data"], r["size"], codec="zstd", asbytes=True)
    at, h = 0, {}
    for name, t in _HEAD:
        width = np.dtype(t).itemsize
        h[name] = from_planes(data[at : at + n * width], t, n).tolist()
        at += n * width
    spans = []
    for t in (np.int64, np.int32, np.int32):
        width = np.dtype(t).itemsize
        spans.append(from_planes(data[at : at + m * width], t, m))
        at += m * width
    right, last = [], b""
    for s, k in zip(h["share"], h["rest"]):
        last = last[:s] + data[at : at + k]
        right.append(last)
        at += k
    left = []
    for k in h["left"]:
        left.append(data[at : at + k])
        at += k
    return right, h["share"], list(zip(left, h["far"], h["near"], h["many"], h["rid"], h["at"])), np.column_stack(spans)


def _collapsed(records: list[tuple], length: int) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Sorted records with equal ones as one; spans of those that are not alone."""
    out, spans, k = [], [], 0
    while k < len(records):
        e = k + 1
        while e < len(records) and records[e][:4] == records[k][:4]:
            e += 1
        r = records[k]
        if e - k > 1 or r[4]:
            spans += [(x[5], x[6] - x[2], x[6] - x[3] + length) for x in records[k:e] if not x[4]]
            out.append((*r[:4], 1, 0, 0))
        else:
            out.append(r)
        k = e
    return out, spans


class Windows:
    """Gathers groups of suffixes that share their anchor's bytes; finds their windows that repeat."""

    def __init__(self, length: int):
        self.length, self.records, self.group, self.groups = length, [], [], 0

    def add(self, records: list[tuple]) -> None:
        self.records += records
        self.group += [self.groups] * len(records)
        self.groups += 1

    def spans(self) -> list[tuple[int, int, int]]:
        m, length = len(self.records), self.length
        reach = length - GRAM
        far, near = np.array([r[2] for r in self.records]), np.array([r[3] for r in self.records])
        right = np.frombuffer(b"".join([r[0].ljust(length, b"\0") for r in self.records]), np.uint8).reshape(m, length)
        left = np.frombuffer(b"".join([r[1].ljust(reach, b"\0") for r in self.records]), np.uint8).reshape(m, reach) if reach else np.zeros((m, 0), np.uint8)
        up = _powers(_P, length)
        r = (_T[right] * up[None, :length]).sum(axis=1, dtype=np.uint64)
        g = mix(np.array(self.group, np.uint64) + np.uint64(1))
        l, found = np.zeros(m, np.uint64), np.zeros((m, reach + 3), np.int8)
        for o in range(reach + 1):
            use = np.flatnonzero((near <= o) & (o <= far))
            if len(use) > 1:
                key = mix(mix(g[use] + l[use]) + r[use])
                order = np.argsort(key, kind="stable")
                same = np.zeros(len(use), bool)
                same[1:] = key[order][1:] == key[order][:-1]
                same[:-1] |= same[1:]
                found[use[order][same], o + 1] = 1
            if o < reach:
                r = r - _T[right[:, length - 1 - o]] * up[length - 1 - o]
                l = l + _T[left[:, o]] * up[o]
        change = np.diff(found, axis=1)
        row, first = np.nonzero(change == 1)
        _, after = np.nonzero(change == -1)
        many = np.array([x[4] for x in self.records])
        out = []
        for i, a, b in zip(row.tolist(), first.tolist(), after.tolist()):
            if not many[i]:
                x = self.records[i]
                out.append((x[5], x[6] - (b - 1), x[6] - a + length))
        self.records, self.group, self.groups = [], [], 0
        return out


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(rid, s, e): byte ranges of texts that repeated windows cover; ranges may overlap."""
    session = docs.sparkSession
    buckets = 4 * partitions(session)
    keys = repeated_anchors(docs, length).groupBy("rid").agg(F.collect_list("keys").alias("keys")).withColumnRenamed("rid", "of")
    open_ = docs.join(keys, F.col("rid") == F.col("of"))
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("known", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush():
            held.sort(key=lambda x: x[0])
            rows, k = [], 0
            while k < len(held):
                e = k
                while e < len(held) and held[e][0] == held[k][0]:
                    e += 1
                records, spans = _collapsed(sorted(x[1:] for x in held[k:e]), length)
                rows.append(_pack_run(records, held[k][0], spans))
                k = e
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for b in steps(batches):
            data, ends = text_bytes(b.column("text"))
            rows, at, far, near, key = anchors(hasher, data, ends, length)
            if not len(rows):
                continue
            wanted = [np.frombuffer(b"".join(x), np.uint64) for x in b.column("keys").to_pylist()]
            row_of = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
            salt = lambda r: mix(r.astype(np.uint64) + np.uint64(1))
            use = np.isin(key ^ salt(rows), np.concatenate(wanted) ^ salt(row_of))
            rows, at, far, near, key = rows[use], at[use], far[use], near[use], key[use]
            text, rid = data.tobytes(), b.column("rid").to_numpy()[rows].tolist()
            local = (at - ends[rows]).tolist()
            for bucket, d, p, a, f, e in zip(bucket_of(key, buckets).tolist(), rid, at.tolist(), local, far.tolist(), near.tolist()):
                held.append((bucket, text[p : p + length - e], text[p - f : p][::-1], f, e, 0, d, a))
                size += length + f - e
            if size >= RUN_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                by.setdefault(r["bucket"], []).append(r)
        for bucket in sorted(by):
            runs, tails, spans = [], [], []
            for r in by.pop(bucket):
                right, share, tail, known = _unpack_run(r)
                runs.append((right, share))
                tails.append(tail)
                if len(known):
                    spans.append(known)
            windows, group = Windows(length), []

            def close(group=group, windows=windows, spans=spans):
                if len(group) > 1:
                    records, sure = _collapsed(sorted(group), length)
                    if sure:
                        spans.append(np.array(sure, np.int64))
                    if len(records) > 1 and not all(r[4] for r in records):
                        windows.add(records)
                group.clear()

            for run, k, share in merged(runs):
                if share < GRAM:
                    close()
                    if len(windows.records) >= COMPARED:
                        spans.append(np.array(windows.spans(), np.int64).reshape(-1, 3))
                group.append((runs[run][0][k], *tails[run][k]))
            close()
            if windows.records:
                spans.append(np.array(windows.spans(), np.int64).reshape(-1, 3))
            if spans:
                found = np.concatenate(spans)
                yield _spread(found)

    runs = open_.select("rid", "keys", "text").mapInArrow(sorted_runs, "bucket int, n int, known int, size long, data binary")
    return runs.repartition(partitions(session), "bucket").mapInArrow(combined, "rid long, s int, e int")


def _spanned(docs: DataFrame, length: int) -> DataFrame:
    """(row, spans): the rows of ``docs`` as they are, and an array of (s, e), null where nothing repeats. Rows are
    told apart by a hash of id and text; those that agree in both have the same spans."""
    rid = F.xxhash64("doc_id", "text")
    found = repeated_spans(docs.select(rid.alias("rid"), "text"), length).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    keyed = docs.select(F.struct(*map(ref, docs.columns)).alias("row"), rid.alias("of"))
    return keyed.join(found, F.col("rid") == F.col("of"), "left").select("row", "spans")


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``spans`` (see ``_spanned``), in place of a column of this name."""
    rest = [c for c in docs.columns if c != "spans"]
    return _spanned(docs.select(*map(ref, rest)), length).select(*[F.col("row").getField(c).alias(c) for c in rest], "spans")


def _kept(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple[list[bytes], int, int]:
    """Parts that stay, bytes removed, and maximal removed runs."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    first, last = s[new], e[np.append(new[1:], len(s)) - 1]
    parts = [text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)])]
    return parts, int((last - first).sum()), len(first)


def cut(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but its text, with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and
    the remaining ``text`` if asked for (a character cut apart goes with what was removed). Columns named as a result
    are replaced, others pass through, whatever they are called."""
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    keep = [c for c in docs.columns if c not in [*results, "text"]]
    schema = T.StructType().add("kept", T.StructType([docs.schema[c] for c in keep]))
    for c in results[:3]:
        schema = schema.add(c, T.LongType())
    schema = schema.add("kept_sha256", T.StringType())
    schema = schema.add("text", T.StringType()) if with_text else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            data, ends = text_bytes(b.column("text"))
            data, spans = data.tobytes(), b.column("spans")
            flat = spans.flatten()
            s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())])
            out = {c: [] for c in [*results, "text"]}
            for i in range(b.num_rows):
                text = data[ends[i] : ends[i + 1]]
                parts, gone, runs = [text], 0, 0
                if at[i + 1] > at[i]:
                    parts, gone, runs = _kept(text, s[at[i] : at[i + 1]], e[at[i] : at[i + 1]])
                left = b"".join(parts)
                for c, v in zip(results, (len(text), gone, runs, hashlib.sha256(left).hexdigest())):
                    out[c].append(v)
                if with_text:
                    out["text"].append(b"".join([p.decode("utf-8", "ignore").encode() for p in parts]).decode() if gone else text.decode())
            columns = [b.column("kept"), *[pa.array(out[c], pa.int64()) for c in results[:3]], pa.array(out["kept_sha256"], pa.string())]
            names = ["kept", *results]
            if with_text:
                columns.append(pa.array(out["text"], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    boxed = docs.select(F.struct(*map(ref, keep)).alias("kept"), "doc_id", "text")
    cleaned = _spanned(boxed, length).select("row.kept", "row.text", "spans").mapInArrow(run, schema)
    return cleaned.select(*[F.col("kept").getField(c).alias(c) for c in keep], *[c for c in cleaned.columns if c != "kept"])
