"""Operator 10: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: XXH64 (seed 42) of the lower-cased 3-word shingles, majority vote
per bit.  Two fingerprints link at ``RADIUS`` = 3 or fewer differing bits.

Covering family (Pagh 2016): bit i gets a random vector m(i) of r + 1 = 4 bits;
table v (each of the 15 non-zero 4-bit vectors) keeps the bits with
<m(i), v> = 1.  If two fingerprints differ in three positions or fewer, the
vectors of these positions span at most three dimensions, so some non-zero v is
orthogonal to all of them and table v keeps none of the positions: every pair
within the radius collides in some table, with certainty.

Equal fingerprints are collapsed first (partial aggregation), so copies cost one
row each and a group of copies of any size is one row per map task. Buckets hold
distinct fingerprints and are read as a sorted stream; a bucket gives only the
edges of a spanning forest.  Small buckets are compared in blocks; in a
large one each fingerprint looks up the ball of radius 3 in the bits that the
table leaves out, so the work is linear in the bucket, without a cap.

Defined results: null or wordless text: fingerprint 0, linked like any other;
repeated rows: each row is returned; empty table: empty result; doc_id null:
the row is returned and takes part (smallest id ignores nulls).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_rows, discard, saved, texts_of, unused_prefix

RADIUS = 3
#: Buckets up to this size are compared pair by pair; larger ones by look-ups.
SMALL_BUCKET = 2048
EDGES_PER_FILE = 500_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_VECTORS = np.random.default_rng(3).permutation(np.arange(64) % 15 + 1)


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each covering table keeps."""
    assert radius == RADIUS
    return [sum(1 << i for i in range(64) if bin(int(_VECTORS[i]) & v).count("1") & 1) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text (used per document; see the module's docstring)."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    if len(words) >= 3:
        starts, ends = starts[:-2], ends[2:]
    else:
        starts, ends = starts[:1], ends[-1:]
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            fps = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)
            yield arrow_rows(schema, doc_id=batch.column(0), fp=pa.array(fps.view(np.int64)))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_edges(fps: np.ndarray, free: int) -> np.ndarray:
    """Spanning edges (n, 2) of the links among distinct fingerprints that agree outside the bits ``free``."""
    n = len(fps)
    parent = np.arange(n)
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((i, j))

    if n <= SMALL_BUCKET:
        step = max(1, (1 << 18) // n)
        for a in range(0, n, step):
            part = fps[a : a + step]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ fps[None, :]) <= RADIUS)
            keep = i + a < j
            join(i[keep] + a, j[keep])
    else:
        order = np.argsort(fps)
        ordered = fps[order]
        bits = [1 << i for i in range(64) if free >> i & 1]
        for size in range(1, RADIUS + 1):
            for flips in combinations(bits, size):
                other = ordered ^ np.uint64(sum(flips))
                at = np.minimum(np.searchsorted(ordered, other), n - 1)
                hit = np.flatnonzero((ordered[at] == other) & (ordered < other))
                join(order[hit], order[at[hit]])
    return fps[np.array(edges, int)].reshape(-1, 2) if edges else np.zeros((0, 2), np.uint64)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges whose transitive closure is that of all links among the fingerprints of ``distinct`` (fp)."""
    kept = masks()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    free = {v: ~m & (2**64 - 1) for v, m in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def close():
            fps = np.concatenate(held) if len(held) > 1 else held[0]
            if len(fps) > 1:
                found = bucket_edges(fps, free[held_key[0]]).view(np.int64)
                if len(found):
                    yield arrow_rows(schema, a=found[:, 0], b=found[:, 1])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(t)]])
            sizes = np.diff(bounds)
            many = np.flatnonzero(sizes > 1)
            for g in sorted({0, len(sizes) - 1, *many.tolist()}):
                a, b = int(bounds[g]), int(bounds[g + 1])
                now = (int(t[a]), int(key[a]))
                if held_key is not None and now != held_key:
                    yield from close()
                    held, held_key = [], None
                if g == len(sizes) - 1 or held_key == now:
                    held.append(fp[a:b])
                    held_key = now
                elif b - a > 1:
                    found = bucket_edges(fp[a:b], free[now[0]]).view(np.int64)
                    if len(found):
                        yield arrow_rows(schema, a=found[:, 0], b=found[:, 1])
        if held_key is not None:
            yield from close()

    tables = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >> 63 else m)).alias("key")) for v, m in enumerate(kept)])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("x.key").alias("key"), "fp")
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b), the root being the component's smallest node (signed order).

    Alternating large-star and small-star steps (Kiveris et al. 2014) as joins
    with pre-aggregated minima: no neighbour list is ever gathered, and the join
    on a hub's edges is an ordinary sort-merge join that can be split.  Each round
    is written to the shared folder, so lost executors cost one round at most.
    """
    # a round writes as many files as its edges need, not as many as there are shuffle partitions
    keep = lambda df, n: saved(df.coalesce(max(12, n // EDGES_PER_FILE)))
    # dealt by another key than the join's: the minima are then no part of the join's stage, and adaptive execution can split a hub's edges
    apart = lambda df: df.repartition(F.xxhash64("u"))
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    stamp = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    mark = stamp(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, now = now, keep(small.select("e.u", "e.v").where("u <> v").distinct(), mark[0])
        mark, last = stamp(now), mark
        discard(before)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id of the component."""
    fps = saved(fingerprints(docs, doc_id, text))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp")))
    named = saved(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns that ``docs`` came with: the smallest doc_id (nulls last).

    Rows are told apart by a hash of doc_id and text, so repeated rows count as copies of one another.
    """
    own = unused_prefix(docs)
    marked = docs.withColumn(own, F.xxhash64(F.col("doc_id"), F.col("text")))
    found = saved(near_duplicates(marked, own).select(F.col("doc_id").alias("key"), "component_id"))
    ids = marked.select(F.col(own).alias("k2"), F.col("doc_id").alias("id2")).distinct()
    first = F.min(F.struct(F.col("id2").isNull(), F.col("id2"), F.col("key"))).alias("first")
    stay = found.distinct().join(ids, F.col("key") == F.col("k2")).groupBy("component_id").agg(first).select(F.col("first.key").alias(f"{own}s"))
    kept = marked.join(stay, F.col(own) == F.col(f"{own}s"), "left_semi")
    if found.count() != found.select("key").distinct().count():  # rows that are equal in full
        kept = kept.dropDuplicates([own])
    return kept.drop(own)
