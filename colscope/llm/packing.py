"""Cost-balanced packing of token ids into sequences of a fixed length.

Each task tokenises its documents and packs them shard by shard; a shard is what it has gathered once that comes to
``SHARD_TOKENS`` ids, so memory is bounded by a shard and its longest document, and nothing is shuffled. Within a shard:

* A document's ids are cut into units of at most one sequence. A unit of L ids costs
  ``linear * L + quadratic * L * L``: attention stays within a unit, so many short ones cost less than a long one.
* The shard's sequences are as many full ones as its ids fill, and the rest as powers of two, which need no
  padding. Capacity and ids are thus equal in sum, and no sequence is padded.
* Units go in descending order, each to the sequence of lowest cost so far that has room for all of it. If none has, it
  fills the one of lowest cost that has any room, and what is left of it goes on in the same way.

A shard depends on the order of a task's rows alone, so a task that runs again packs alike.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.llm.words import steps

#: Ids that are packed together: 512 sequences of 2,048.
SHARD_TOKENS = 1 << 20
#: Bytes of text that are tokenised at once.
SLICE_BYTES = 1 << 20
#: Fixed value: how the byte-level tokenizer cuts a text into words, each of which it encodes by itself.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts, as the ``tokenizers`` library gives them with ``add_special_tokens=False``.

    The library takes four times as long as ``tiktoken`` for the same merges, so the vocabulary and merges are read from the file
    and applied by the latter. Texts that name a special token, and those with blanks too many for its
    pattern, go to the library itself, as do all texts where the file is not a byte-level one with ids in merge order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        with open(path, encoding="utf-8") as file:
            self.fast = _merger(json.load(file), set(special))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text; null is empty."""
        if not text:
            return np.zeros(0, np.int32)
        if self.fast and not (self.special and self.special.search(text)):
            try:
                return np.array(self.fast.encode_ordinary(text), np.int32)
            except BaseException as overflow:  # not an Exception: its pattern ran out of stack
                if type(overflow).__name__ != "PanicException":
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


def _merger(file: dict, special: set[str]) -> tiktoken.Encoding | None:
    """The same merges for ``tiktoken``, if ids are in their order."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    # byte-level files write printable bytes as themselves and the others as the characters from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    return tiktoken.Encoding("packing", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})


def capacities(tokens: int, length: int) -> np.ndarray:
    """Full sequences, and the powers of two that the rest is made of."""
    full, rest = divmod(tokens, length)
    return np.array([length] * full + [1 << k for k in reversed(range(length.bit_length())) if rest >> k & 1], np.int64)


def balance(sizes: np.ndarray, length: int, linear: float, quadratic: float) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, size, sequence, offset) of documents of ``sizes`` ids, in the documents' order."""

    def cost(n):
        return linear * n + quadratic * n * n

    units = -(-sizes // length)
    of = np.repeat(np.arange(len(sizes)), units)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)) * length
    size = np.minimum(sizes[of] - start, length)
    # a unit as long as a sequence takes the next empty one, which has the lowest cost
    full = size == length
    n_full = int(full.sum())
    out = [(of[full], start[full], size[full], np.arange(n_full), np.zeros(n_full, np.int64))]
    of, start, size = of[~full], start[~full], size[~full]
    room = capacities(int(size.sum()), length)
    used, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    pieces = []
    for i in np.argsort(-size, kind="stable").tolist():
        doc, at, left = int(of[i]), int(start[i]), int(size[i])
        while left:
            k = int(np.where(room >= left, spent, np.inf).argmin())
            if room[k] < left:
                k = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(left, int(room[k]))
            pieces.append((doc, at, take, n_full + k, int(used[k])))
            room[k] -= take
            used[k] += take
            spent[k] += cost(take)
            at, left = at + take, left - take
    if pieces:
        out.append(tuple(np.array(c, np.int64) for c in zip(*pieces)))
    columns = [np.concatenate(c) for c in zip(*out)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def pack(
    docs: DataFrame,
    path: str,
    end: int = 1,
    length: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's, as little-endian 32-bit numbers; a document's are those of the tokenizer at
    ``path`` and then ``end``. Null and empty texts are that one id. Rows with null or repeated ids are documents of their
    own; other columns are not read. Very long texts are cut over as many sequences as they fill. An empty table gives
    no rows. Sequences are numbered by task and place, uniquely, and no sequence needs padding.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        following = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        gathered = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, gathered, following
            sizes = np.array([len(i) for i in ids], np.int64)
            doc, start, size, sequence, offset = balance(sizes, length, linear, quadratic)
            flat = np.concatenate(ids).astype("<i4")
            # the pieces in order are all ids in order, so they share one buffer
            ends = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            rows = pa.concat_arrays(keys).take(pa.array(doc))
            columns = [rows, pa.array(start), pa.array(size), data, pa.array(sizes[doc]), pa.array(following + sequence), pa.array(offset)]
            following += int(sequence.max()) + 1
            keys, ids, gathered = [], [], 0
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in steps(batches, limit=SLICE_BYTES):
            at = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids.append(np.append(encoder.ids(text), np.int32(end)))
                gathered += len(ids[-1])
                if gathered >= shard_tokens:
                    keys.append(batch.column("doc_id").slice(at, i + 1 - at))
                    at = i + 1
                    yield close()
            if at < batch.num_rows:
                keys.append(batch.column("doc_id").slice(at))
        if ids:
            yield close()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame, length: int = 2048, pad: int = 1) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (padded to ``length`` unless n_tokens is a power of two), and
    parts (offset, doc_id, start, length) in order, within which attention stays.

    A group is one sequence, so its size is bounded. ``pieces`` that are read more than once should be a written table.
    """
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda got, p: F.concat(got, p["ids"]))
    exact = F.bit_count("n_tokens") == 1
    padded = F.rpad(ids, length * 4, F.lit(pad.to_bytes(4, "little")))
    parts = F.transform("all", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length")))
    return rows.select("sequence_id", "n_tokens", F.when(exact, ids).otherwise(padded).alias("ids"), parts.alias("parts"))
