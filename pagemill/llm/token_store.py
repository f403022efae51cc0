"""Operator 2: token ids in a Simple-8b word-aligned binary store.

Tokens: the ``tokenizers`` library over each distinct word of a block of texts;
words are split at ASCII white space, which the vocabulary's own pre-tokenizer
drops and never joins across, so the ids are those of the whole text.  Results
are kept in a bounded per-worker cache.

Format (a table of blocks, in ascending doc_id order; Parquet is the container,
so writing is atomic and any store that Spark reads will do): each document is a
run of 64-bit words, low four bits a selector, 60 bits of payload that hold
``COUNTS[selector]`` ids of ``BITS[selector]`` bits each; the last word of a
document is padded with zeros. ``ESCAPE`` stands for an id that 15 bits cannot hold; such
ids follow in a list of unsigned 32-bit integers.  A block carries for each document the
offsets of its words, ids and escapes, so blocks, and documents in them, decode
independently, one vector operation per selector.

Defined results: null text: empty, hence only the end id; repeated doc_ids: one
row each, next to one another, ordered by text; null doc_id: first; empty table: no blocks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import CHUNK_BYTES, Words, blocks, mix, powers, new_path, text_bytes, texts_of

END_ID = 1
#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15])
ESCAPE = (1 << 15) - 1
MAX_CACHED = 600_000
_PAD = int(COUNTS[0])
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
# byte-level alphabet: bytes that are no printable Latin-1 characters are named by the code points from 256 on
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_LENGTHS = np.searchsorted(1 << np.arange(16), np.arange(1 << 15), "right").astype(np.uint8)


def _only_letters(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which byte ranges are letters only: a-z and U+00C0 to U+00FF but for the signs x and division."""
    buf = np.frombuffer(raw, np.uint8)
    good = (buf >= 97) & (buf <= 122)
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    good[lead] = good[lead + 1] = True
    sums = np.concatenate([[0], np.cumsum(good)])
    return sums[end] - sums[start] == end - start


class Tokenizer:
    """Ids of texts, by distinct piece of a word, with a bounded cache.

    A piece is a word in lower case (the vocabulary's normaliser does the same) without the ASCII signs at its end,
    which are a piece of their own if a letter or digit is before them: the pre-tokenizer always cuts there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this worker one core
        self.library = Library.from_file(path)
        self.model = self.library.model
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, raw: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        plain = _only_letters(raw, start, end)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        keys, start, end, n_plain = keys[order], start[order], end[order], int(plain.sum())
        pieces = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        # a piece of letters is one word of the pre-tokenizer, so the library's model can have it without the other steps
        found = [[t.id for t in self.model.tokenize(x if x.isascii() else x.lower().encode().decode("latin-1").translate(_BYTE_LEVEL))] for x in pieces[:n_plain]]
        rest = [x.ids for x in self.library.encode_batch_fast(pieces[n_plain:], add_special_tokens=False)]
        found += rest
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids, n = np.fromiter(chain.from_iterable(found), np.int64), len(self.keys)
        total = len(ids)
        back = np.argsort(keys)
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        if n + len(keys) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * (n + len(keys))), np.resize(self.size, 2 * (n + len(keys)))
        self.flat[self.used : self.used + total] = ids
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.used += total
        at = np.searchsorted(self.keys, keys[back])
        self.keys, self.rows = np.insert(self.keys, at, keys[back]), np.insert(self.rows, at, n + back)

    def encode(self, data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the documents a to b with their end ids, ids per document)."""
        if len(self.keys) > MAX_CACHED:
            self.clear()
        body = data[offsets[a] : offsets[b]]
        # special tokens are matched before lower-casing, so a block that may hold one is left as it is
        special = bool(((body[:-1] == 60) & (body[1:] == 124)).any())
        w = Words(data, offsets, a, b, lower=not special)
        start, end = w.start, w.end
        if len(end) and not special:
            buf = w.data
            # where the run of ASCII signs at a word's end begins, and whether a letter or digit is before it
            body = np.maximum.accumulate(np.where(_SIGN[buf], -1, np.arange(len(buf))))[end - 1] + 1
            last = buf[np.maximum(body - 1, 0)]
            latin = (buf[np.maximum(body - 2, 0)] == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
            plain = ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
            cut = np.flatnonzero((body > start) & (body < end) & (plain | latin))
            start, end = np.insert(start, cut + 1, body[cut]), np.insert(end, cut, body[cut])
        sums, (_, down) = w.sums(), powers(len(w.data) + 1)
        own = mix((sums[end] - sums[start]) * down[start])
        order = np.argsort(own)
        ordered = own[order]
        new = np.ones(len(own), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        keys = ordered[new]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            example = order[new][~known]
            self._learn(w.data.tobytes(), keys[~known], start[example], end[example])
        row = np.empty(len(own), np.int64)
        row[order] = self.rows[np.searchsorted(self.keys, keys)][np.cumsum(new) - 1] if len(keys) else 0
        sizes = self.size[row]
        before = np.zeros(len(own) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        first = np.searchsorted(start, w.doc_start)  # of each document
        doc_ids = np.diff(before[first])
        source = np.repeat(self.start[row] - before[:-1], sizes) + np.arange(before[-1])
        out = np.full(before[-1] + w.n_docs, END_ID, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(doc_ids + 1) - 1] = False
        out[keep] = self.flat[source]
        return out, doc_ids + 1


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words per document, escapes, escapes per document) of documents of ``sizes`` ids."""
    n_docs = len(sizes)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(n_docs), sizes)
    big = ids >= ESCAPE
    escapes, escaped = ids[big], np.bincount(doc[big], minlength=n_docs)
    value = np.zeros(len(ids) + _PAD * n_docs, np.uint16)  # padded, so that no word reaches into the next document
    own = np.repeat(np.arange(n_docs), sizes + _PAD)
    value[np.arange(len(ids)) + _PAD * doc] = np.minimum(ids, ESCAPE)
    need = _LENGTHS[value]
    selector = np.full(len(value), len(COUNTS) - 1, np.int8)
    most, span = need, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        n = int(COUNTS[s])
        while span < n:
            step = min(span, n - span)
            most = np.maximum(most[: len(most) - step], most[step:])
            span += step
        fits = np.flatnonzero(most <= BITS[s])
        if not len(fits):
            break
        selector[fits] = s
    follow = np.arange(len(value)) + COUNTS[selector]
    start = np.concatenate([[0], ends[:-1]]) + _PAD * np.arange(n_docs)
    stop = start + sizes
    # from the last word of a document to the first of the next
    past = np.flatnonzero(follow >= stop[own])
    follow[past] = np.append(start[1:], len(value))[own[past]]
    hop, at, i, n = follow.tolist(), [], 0, len(value)
    while i < n:
        at.append(i)
        i = hop[i]
    at = np.array(at, np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64)
    for s in range(len(COUNTS)):
        own = np.flatnonzero(chosen == s)
        if len(own):
            payload, base = np.zeros(len(own), np.uint64), at[own]
            for j in range(int(COUNTS[s])):
                payload |= value[base + j].astype(np.uint64) << np.uint64(4 + j * int(BITS[s]))
            words[own] |= payload
    return words, np.bincount(np.searchsorted(start, at, "right") - 1, minlength=n_docs), escapes.astype(np.uint32), escaped


def unpack(words: np.ndarray, n_words: np.ndarray, sizes: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of documents that :func:`pack` has packed."""
    chosen = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[chosen]
    before = np.cumsum(count) - count
    first = np.cumsum(n_words) - n_words
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), n_words)
    place = before - before[first][doc] + starts[doc] if len(words) else before
    stop = ends[doc]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    for s in range(len(COUNTS)):
        own = np.flatnonzero(chosen == s)
        if not len(own):
            continue
        payload, base, limit, low = words[own] >> np.uint64(4), place[own], stop[own], np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            inside = base + j < limit
            out[base[inside] + j] = payload[inside] & low
            payload = payload >> np.uint64(int(BITS[s]))
    out[out == ESCAPE] = escapes
    return out


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("total", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("n_escapes", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary())])
_BLOCK_DDL = "shard int, block long, total long, doc_ids array<long>, n_tokens array<long>, n_words array<long>, n_escapes array<long>, words binary, escapes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize ``docs`` and write the store at ``path``, in ascending doc_id order over its shards and blocks."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    _, n_bytes = text_bytes(picked)
    # no more tasks than the bytes need: each short task may start a Python worker of its own
    ranged = picked.repartitionByRange(max(12, -(-n_bytes // CHUNK_BYTES)), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number = tokenizer(tokenizer_path), 0
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, b in blocks(offsets):
                ids, sizes = tok.encode(data, offsets, a, b)
                words, n_words, escapes, n_escapes = pack(ids, sizes)
                own = [pa.array([batch.column(0)[a:b].to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (sizes, n_words, n_escapes)]]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(2)[a].as_py()], pa.int32()), pa.array([number]), pa.array([int(sizes.sum())]), *own, pa.array([words.tobytes()], pa.binary()), pa.array([escapes.tobytes()], pa.binary())], schema=_BLOCK)
                number += 1

    ranged.mapInArrow(run, _BLOCK_DDL).write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks with ``start``, the number of ids before each."""
    store = spark.read.parquet(path)
    # two steps, so that no task sees more than the shards' totals or one shard's blocks
    shards = store.groupBy("shard").agg(F.sum("total").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = store.select("shard", "block", "total").select("shard", "block", (F.sum("total").over(Window.partitionBy("shard").orderBy("block")) - F.col("total")).alias("inner"))
    starts = inside.join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("start"))
    return store.join(starts, ["shard", "block"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the store at ``path``, decoded from it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                ids = unpack(np.frombuffer(row["words"], np.uint64), np.array(row["n_words"], np.int64), sizes, np.frombuffer(row["escapes"], np.uint32))
                ends = np.cumsum(sizes)
                raw, at = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], schema=schema)

    return read_blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document in the store at ``path``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                ids = unpack(np.frombuffer(row["words"], np.uint64), np.array(row["n_words"], np.int64), sizes, np.frombuffer(row["escapes"], np.uint32))
                parts = np.split(ids.astype(np.int64), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], schema=schema)

    return spark.read.parquet(path).mapInArrow(run, "doc_id long, ids array<long>")


def store_path(spark: SparkSession) -> str:
    return new_path(spark)


def tokenize_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the store in the shared folder and read it back."""
    spark = docs.sparkSession
    path = store_path(spark)
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(spark, path)
