"""Shared kernels for the training-data operators.

Everything here works on Arrow buffers: a batch of texts is one numpy byte
array, words are found with vectorised comparisons and identified by 64-bit
polynomial hashes taken from prefix sums, so no Python object is made per word.

Conventions that hold for every operator of this subpackage:

* a null text counts as the empty text; a null ``doc_id`` is kept as a row;
* only the columns that an operator names are read, so extra columns, whatever
  they are called, cannot clash with its working columns; where a filtering operator hands the
  columns on, its own ones have a prefix that no given column has;
* an empty table gives an empty result with the documented schema;
* nothing is cut: whole texts, all rows, groups of any size.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk should hold; chunks are the unit that an
#: executor task keeps in memory, so their number grows with the input.
CHUNK_BYTES = 12 << 20
#: Bytes of text handled by the vectorised kernels at a time.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), BLOCK_BYTES + 4096)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS = np.cumprod(up), np.cumprod(down)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes each (a longer document is a range of its own)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# First and last code points of scripts without spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han), and of
# punctuation beyond ASCII that parts words.
SIGNS = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))
MARKS = ((0x2010, 0x2027), (0x2030, 0x205E), (0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def parted(buf: np.ndarray) -> np.ndarray | None:
    """Where single signs begin and end in the UTF-8 bytes ``buf``, whose marks become spaces; None if it has no sign."""
    at = np.flatnonzero(buf >= 0xE0)
    if not len(at):
        return None
    tail = [(buf[np.minimum(at + j, len(buf) - 1)] & 63).astype(np.int64) for j in (1, 2, 3)]
    three = ((buf[at] & 15).astype(np.int64) << 12) | (tail[0] << 6) | tail[1]
    long = buf[at] >= 0xF0
    code = np.where(long, ((buf[at] & 7).astype(np.int64) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2], three)
    within = lambda ranges: np.logical_or.reduce([(code >= a) & (code <= b) for a, b in ranges])
    for j in range(3):
        buf[at[within(MARKS)] + j] = 32
    sign = within(SIGNS)
    if not sign.any():
        return None
    cut = np.zeros(len(buf) + 1, bool)
    cut[at[sign]] = True
    cut[at[sign] + np.where(long[sign], 4, 3)] = True
    return cut


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a range of documents, as positions and 64-bit ids.

    ``data``: the bytes, one space after each document; ``start``/``end``: byte
    range of each word; ``doc``: its document (index in the range); ``first``:
    index of each document's first word, with one more at the end.  With ``signs``, every sign of a script
    without spaces is a word of its own, and punctuation of any script parts words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: int = 0, b: int | None = None, lower: bool = False, signs: bool = False):
        b = len(offsets) - 1 if b is None else b
        own = offsets[a : b + 1] - offsets[a]
        n_docs = b - a
        body = data[offsets[a] : offsets[b]]
        if lower:
            body = _LOWER[body]
        buf = np.full(len(body) + n_docs, 32, np.uint8)
        keep = np.ones(len(buf), bool)
        keep[own[1:] + np.arange(n_docs)] = False
        buf[keep] = body
        self.data, self.doc_start, self.n_docs = buf, own + np.arange(n_docs + 1), n_docs
        cut = parted(buf) if signs else None
        solid = ~_SPACE[buf]
        edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        if cut is None:
            self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        else:
            here, before = np.append(solid, False), np.concatenate([[False], solid])
            self.start, self.end = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
        self.first = np.searchsorted(self.start, self.doc_start)
        self.count = np.diff(self.first)
        self._sums = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)

    def sums(self) -> np.ndarray:
        """Prefix sums of byte value times base**position."""
        if self._sums is None:
            up, _ = powers(len(self.data))
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * up, out=self._sums[1:])
        return self._sums

    def ids(self) -> np.ndarray:
        """A 64-bit id of each word: equal for equal bytes."""
        sums, (_, down) = self.sums(), powers(len(self.data) + 1)
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit ids of the runs of ``n`` successive word ids (length ``len(ids) - n + 1``)."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= _BASE
        out += ids[j : j + m]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by doubling."""
    if len(x) < w:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, delta-coded and split by byte."""
    parts = [np.ascontiguousarray(np.diff(np.ascontiguousarray(c).view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.compress(b"".join(parts), 1)


def stretch(data: bytes, n: int, k: int) -> list[np.ndarray]:
    """The ``k`` columns of ``n`` numbers that ``squeeze`` packed."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(k, 8, n)
    return [np.cumsum(np.ascontiguousarray(raw[i].T).view(np.uint64).reshape(-1), dtype=np.uint64) for i in range(k)]


def unused_prefix(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` has: for working columns beside columns of any name."""
    names, out = [c.lower() for c in docs.columns], "__w"
    while any(c.startswith(out) for c in names):
        out += "_"
    return out


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)


#: Most rows and bytes of an Arrow batch: a worker, and the buffers that feed it, hold a few of these.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bounds of Arrow batches, which are rows only and far too many for long texts by default."""
    for key, value in BATCH.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) in all documents."""
    bound_batches(docs.sparkSession)
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return row["n"] or 0, row["b"] or 0


def chunk_count(n_bytes: int) -> int:
    """Chunks grow with the input, so that a chunk's size does not; beyond a terabyte both grow with the root of it,
    as chunks that exchange messages in pairs send so many of them."""
    size = CHUNK_BYTES * max(1.0, (int(n_bytes) / (1 << 40)) ** 0.5)
    return max(64, math.ceil(int(n_bytes) / size))


def chunk_of(column: str, chunks: int):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(chunks)).cast("int")


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
        if b > a:
            yield i, a, b


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, the warehouse, or on a local master a temporary folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        alone = context.master.split("[")[0] == "local"
        found = (tempfile.gettempdir() if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")) + "/pagemill-shared"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


_written: dict[str, SparkSession] = {}


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is written there is removed when the driver's Python ends, or by ``discard``."""
    path = f"{shared_dir(spark).rstrip('/')}/pagemill-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_written() -> None:
    """Removes every table that ``saved`` has written in this process: results that are not yet read are lost with them."""
    for path in list(_written):
        with contextlib.suppress(Exception):  # the cluster may have ended before
            _remove(path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagemill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``saved`` that nothing will read again."""
    _remove(df._pagemill_path)
