"""Operator 13: near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct 5-word shingles (lower-cased A-Z), as 64-bit hashes; two documents link if
100 * intersection >= 85 * union.

Sketch (Dahlgaard, Knudsen and Thorup 2017), ``BINS`` coordinates: in round i each element falls into one hashed bin with the value
(i, hashed fraction), and a bin keeps its least value; rounds end as soon as every bin is filled.  From round ``BINS`` on all elements fall into
bin i - ``BINS``, so no coordinate can stay empty.  A coordinate of two sets is equal with the probability of their similarity, and the
number of equal ones is concentrated as if all were independent, at the cost of about one pass for sets of many elements.

Banding: ``BANDS`` bands of ``ROWS`` coordinates.  At a similarity of 0.85 two sets share no band with a probability of 8e-7, less above.

Verification is exact and whole, without a comparison of all pairs of a group.  Equal sets are one row.  Each set has a parity map (bit j: parity of
the number of its elements that hash to j); the bits in which two maps differ are a lower bound of the symmetric difference, so a
pair beyond it cannot link.  Rounds over the buckets: guess links from the maps that join different components so far (a spanning
forest of a bucket, not its pairs), confirm them on the full sets of both texts, merge.  When guesses join nothing any more, every pair of a bucket
that is still in different components and within the bound is confirmed: that is what makes the result whole.  Pairs inside a component need no check.

Skew: a bucket is dealt into slices of about ``SLICE`` sets by a hash of set and bucket; the sets outside its largest component, few once
guesses have merged, visit all slices as a stream.  A task holds one slice.  Every step is written, so lost executors repeat one step.

Defined results: fewer than five words: the whole sequence is the one shingle; null, empty or wordless text: empty set, linked with nothing, its own
component; null doc_id: takes part, but the smallest id ignores it (a component of nulls only has null, and they are kept); repeated rows: each is
returned; an empty table gives an empty result. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BLOCK_BYTES, Words, arrow_rows, blocks, bound_batches, gram_ids, mix, saved, texts_of
from pagemill.llm.simhash import components

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: Bands of the first round of guesses: it joins most of what will be joined.
FIRST_BANDS = 3
SLICE = 2048
_ROUNDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(2**64 - 1)
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_TESTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of documents a to b - 1."""
    words = Words(data, offsets, a, b, lower=True)
    ids = words.ids()
    grams = gram_ids(ids, SHINGLE)
    out = []
    for first, n in zip(words.first.tolist(), words.count.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(grams[first : first + n - SHINGLE + 1]))
        elif n:
            out.append(mix(gram_ids(ids[first : first + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS): round << 32 | fraction of the least element of each bin; empty sets keep the largest number."""
    out = np.full((len(sets), BINS), _EMPTY)
    flat = out.reshape(-1)
    sizes = np.array([len(x) for x in sets], np.int64)
    own, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    for i in range(2 * BINS):
        if not len(items):
            break
        h = mix(items ^ _ROUNDS[i])
        bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64) if i < BINS else np.full(len(h), i - BINS)
        np.minimum.at(flat, own * BINS + bins, (np.uint64(i) << np.uint64(32)) | (h & np.uint64(2**32 - 1)))
        open_ = (out == _EMPTY).any(1)[own]
        own, items = own[open_], items[open_]
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """(sets, BANDS): a hash of each band's coordinates and number."""
    h = np.zeros((len(sketch), BANDS), np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j::ROWS])
    return mix(h + np.arange(1, BANDS + 1, dtype=np.uint64))


def parity_map(items: np.ndarray) -> np.ndarray:
    """Parities of the elements by their low bits, as 64-bit words: 512 bits at least, and two to four an element."""
    size = max(512, 2 << (len(items) - 1).bit_length())
    return np.packbits((np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if not len(x) or not len(y) or PERCENT * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def marks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n, set_key, bands, parity) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("set_key", pa.int64()), ("bands", pa.list_(pa.int64())), ("parity", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            for a, b in blocks(offsets, BLOCK_BYTES):
                sets = shingle_sets(data, offsets, a, b)
                keys = mix(np.array([mix(x ^ _ROUNDS[0]).sum(dtype=np.uint64) + np.uint64(len(x)) for x in sets], np.uint64))
                bands = band_hashes(sketches(sets)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
                parity = pa.array([parity_map(x).tobytes() if len(x) else b"" for x in sets], pa.binary())
                yield arrow_rows(schema, doc_id=batch.column(0).slice(a, b - a), text_key=batch.column(1).slice(a, b - a), n=[len(x) for x in sets], set_key=keys.view(np.int64), bands=lists, parity=parity)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text_key long, n long, set_key long, bands array<long>, parity binary")


class _Slice:
    """The sets of a slice: sizes, components and parity maps, the maps grouped by their length."""

    def __init__(self, keys: list[int], comps: list[int], sizes: list[int], maps: list[bytes]):
        self.keys, self.comps, self.sizes = np.array(keys, np.int64), np.array(comps, np.int64), np.array(sizes, np.int64)
        self.maps = [np.frombuffer(m, np.uint64) for m in maps]
        by: dict[int, list[int]] = {}
        for i, m in enumerate(self.maps):
            by.setdefault(len(m), []).append(i)
        self.classes = {w: (np.array(own), np.stack([self.maps[i] for i in own])) for w, own in by.items()}

    def near(self, size: int, parity: np.ndarray, among: np.ndarray, guess: bool) -> np.ndarray:
        """Places in ``among`` (a mask) that can link with the given set; ``guess``: that by the estimated difference probably do."""
        out, w = [], len(parity)
        for width, (own, maps) in self.classes.items():
            if width not in (w, 2 * w) and 2 * width != w:
                continue  # sizes too far apart
            fits = among[own] & (PERCENT * np.maximum(self.sizes[own], size) <= 100 * np.minimum(self.sizes[own], size))
            own, maps = own[fits], maps[fits]
            if not len(own):
                continue
            if width == 2 * w:
                maps, mine = maps[:, :w] ^ maps[:, w:], parity
            else:
                mine = parity if width == w else parity[:width] ^ parity[width:]
            differ = np.bitwise_count(maps ^ mine).sum(1, dtype=np.int64)
            most = (100 - PERCENT) * (self.sizes[own] + size) // (100 + PERCENT)
            if guess:
                bits = 64 * len(mine)
                differ = -bits / 2 * np.log1p(-2 * np.minimum(differ, bits / 2 - 0.5) / bits)
            out.append(own[differ <= most])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def pairs(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of pairs from different components: all within the bound, or a guessed spanning forest."""
        if every:
            for i in range(len(self.keys)):
                among = self.comps != self.comps[i]
                among[:i] = False
                found = self.near(int(self.sizes[i]), self.maps[i], among, False)
                yield np.full(len(found), self.keys[i]), self.keys[found]
            return
        unseen, members = np.ones(len(self.keys), bool), {}
        for i, c in enumerate(self.comps.tolist()):
            members.setdefault(c, []).append(i)
        while unseen.any():
            todo = list(members[int(self.comps[np.argmax(unseen)])])
            unseen[todo] = False
            while todo and unseen.any():
                i = todo.pop()
                found = self.near(int(self.sizes[i]), self.maps[i], unseen, True)
                comps, first = np.unique(self.comps[found], return_index=True)
                yield np.full(len(first), self.keys[i]), self.keys[found[first]]
                for c in comps.tolist():
                    todo += members[c]
                    unseen[members[c]] = False


def candidates(rows: DataFrame, every: bool) -> DataFrame:
    """(a, b): pairs of set keys from the slices of ``rows`` (bucket, slice, visits, key, comp, n, parity); visitors meet only those at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        home, where, met = None, None, set()
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(least: int = 1) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if sum(len(x) for x, _ in out) >= least:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield arrow_rows(_PAIRS, a=np.minimum(a, b), b=np.maximum(a, b))
                out = []

        def settle() -> None:
            nonlocal home, held
            home, held = _Slice(*zip(*held)) if held else None, []
            if home is not None and len(home.keys) > 1:
                out.extend(home.pairs(every))

        for batch in batches:
            for bucket, part, visits, key, comp, n, parity in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, part) != where:
                    if held:
                        settle()
                        yield from flush(1 << 16)
                    home, where, met = None, (bucket, part), set()
                if not visits:
                    held.append((key, comp, n, parity))
                    continue
                if held:
                    settle()
                if home is None:
                    continue
                found = home.near(n, np.frombuffer(parity, np.uint64), home.comps != comp, not every)
                if not every:
                    comps, first = np.unique(home.comps[found], return_index=True)
                    found = found[[f for c, f in zip(comps.tolist(), first.tolist()) if (comp, c) not in met]]
                    met.update((comp, c) for c in comps.tolist())
                out.append((np.full(len(found), key), home.keys[found]))
            yield from flush(1 << 16)
        if held:
            settle()
        yield from flush()

    ordered = rows.select("bucket", "slice", "visits", "key", "comp", "n", "parity").repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "visits", "key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked): each pair tested on the full sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def items(key: int, text) -> np.ndarray:
            if key not in recent:
                recent[key] = shingle_sets(*texts_of(pa.array([text.as_py()], pa.string())), 0, 1)[0]
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(key)
            return recent[key]

        for batch in batches:
            a, b = (c.to_pylist() for c in batch.columns[:2])
            result = [linked(items(x, s), items(y, t)) for x, y, s, t in zip(a, b, batch.column(2), batch.column(3))]
            yield arrow_rows(_TESTED, a=a, b=b, linked=result)

    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, linked boolean")


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(key, comp): components after ``links`` (a, b) have been added to ``comps``; keys without a row are their own."""
    if comps is None:
        return saved(components(links).select(F.col("node").alias("key"), F.col("root").alias("comp")))
    name = lambda side: comps.select(F.col("key").alias(side), F.col("comp").alias(f"{side}_comp"))
    above = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    roots = components(above).select(F.col("node").alias("old"), F.col("root").alias("new"))
    every = comps.unionByName(roots.select(F.col("old").alias("key"), F.col("old").alias("comp"))).distinct()
    every = every.join(roots, F.col("comp") == F.col("old"), "left").select("key", F.coalesce("new", "comp").alias("comp"))
    return saved(every.groupBy("key").agg(F.min("comp").alias("comp")))


def _rows(members: DataFrame, sets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows for ``candidates``: of buckets with sets from several components."""
    own = members if comps is None else members.join(comps, "key", "left")
    own = own.withColumn("comp", F.col("key") if comps is None else F.coalesce("comp", "key"))
    own = own.withColumn("slice", F.pmod(F.xxhash64("key", "bucket"), F.col("slices")))
    at_home = own.select("bucket", "slice", F.lit(False).alias("visits"), "key", "comp")
    if comps is not None:
        by = own.groupBy("bucket", "slices", "comp").agg(F.count(F.lit(1)).alias("n"))
        several = by.groupBy("bucket", "slices").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("kinds > 1").select("bucket", "main")
        own = own.join(several, "bucket")
        at_home = own.select("bucket", "slice", F.lit(False).alias("visits"), "key", "comp")
        guests = own.where("comp <> main and slices > 1").withColumn("at", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int")))).where("at <> slice")
        at_home = at_home.unionByName(guests.select("bucket", F.col("at").cast("long").alias("slice"), F.lit(True).alias("visits"), "key", "comp"))
    return at_home.join(sets.select("key", "n", "parity"), "key")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept); see the module's docstring."""
    bound_batches(docs.sparkSession)
    marked = saved(marks(docs, doc_id, text))
    first = [F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity")]
    sets = saved(marked.where("n > 0").groupBy(F.col("set_key").alias("key")).agg(*first))
    banded = sets.select("key", F.posexplode("bands").alias("band", "bucket"))
    found = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("band").alias("band"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    # the same sets meet in many buckets: one of these is enough
    distinct = found.groupBy("n", "sum").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", F.col("b.band").alias("first_band"), F.ceil(F.col("n") / SLICE).alias("slices"))
    members = saved(banded.join(distinct, "bucket").select("bucket", F.col("first_band").alias("band"), "slices", "key"))
    wanted = sets.join(members.select("key").distinct(), "key", "left_semi").select("key", "text_key")
    own = docs.select(F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    texts = saved(own.join(wanted, "text_key").groupBy("key").agg(F.first("text").alias("text")))
    comps, tested, every = None, None, False
    now = members.where(F.col("band") < FIRST_BANDS)
    while True:
        pairs = candidates(_rows(now, sets, comps), every)
        pairs = pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        result = saved(confirmed(pairs, texts))
        links = result.where("linked").select("a", "b")
        joins = links.limit(1).count() > 0
        if joins or comps is None:
            comps = _merged(comps, links)
        tested = result if tested is None else tested.unionByName(result)
        if every:
            break
        every = not joins and now is members
        now = members
    lows = sets.select("key", "low").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = lows.join(lows.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select(F.col("key").alias("set_key"), "component_id")
    out = marked.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
