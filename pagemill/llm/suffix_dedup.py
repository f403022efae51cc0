"""Operator 1: exact substring dedup with a distributed, sparse suffix array.

A byte goes if a ``WIDTH`` = 50 byte string that covers it also starts in a
document with a smaller doc_id.  Windows never cross documents.

1.  Equal texts are found by hash; of a group of copies only the first document
    goes on (its windows are all windows of the others), the others lose every
    byte that a window covers.
2.  Sparse suffixes.  Every window has an *anchor*, the position of the smallest
    hashed ``GRAM``-byte string in it (leftmost if tied).  Equal windows have equal
    anchors, so only anchor suffixes need sorting: about one position in 15.
3.  Each chunk of documents sends its sorted anchor hashes (delta-coded) with the number of their documents to
    buckets of the hash space; a bucket answers with two bits per hash: do two documents
    have it, and do more than ``HOT``?
4.  Chunks sort the suffixes of these anchors and send **front-coded runs**
    (common-prefix length + rest).  Equal neighbourhoods within a chunk are sent
    once, so a passage in a third of all documents is one entry per chunk.
5.  A bucket combines its runs with a **loser tree that carries the common prefix**
    length with each contender: two contenders whose known prefixes with the last winner differ in length
    are ordered without looking at a byte, and equal ones are compared only beyond
    the known prefix.  The merge yields the suffix array with its LCP array.
6.  For a window that starts ``a`` bytes before its anchor, equal windows are an
    LCP interval of depth 50 - a with the same ``a`` bytes on the left; the
    smallest document of each such class decides.  One bit mask goes back per entry.
7.  Chunks turn masks into removed spans.

Hot anchors, those of more than ``HOT`` documents, would bring one bucket a neighbourhood per document wherever text of the document's own is next to a
passage that very many share.  Their windows are sent one by one instead, each distinct one once a chunk, to the bucket of the window's own hash, and are
merged there with all others: foreign text then spreads over all buckets.

The unit of memory is a chunk (about 12 MB of text) or a bucket (as many as chunks);
both grow in number with the input.

Defined results: null text: empty, nothing removed, sha256 of no bytes; texts
under 50 bytes: nothing removed; repeated rows (same doc_id and text): each is
returned, none removes from the other, since no smaller doc_id has the string;
null doc_id: sorts before all ids; empty table: empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import _BYTE_VALUES, blocks, chunk_count, expand, mix, powers, saved, squeeze, stretch, text_bytes, texts_of, window_min

WIDTH = 50
GRAM = 24
#: Documents that have a hot anchor are more than so many.
HOT = 4096
SPAN = WIDTH - GRAM  # most bytes between a window's start and its anchor
_POS_BITS = np.uint64(28)


def anchors(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that follow one another: position, hash and (smallest, largest) window start of each run of windows with one anchor."""
    n = len(body)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[body] * up[:n], out=sums[1:])
    h = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])
    low = np.uint64((1 << int(_POS_BITS)) - 1)
    best = window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), SPAN + 1)
    at = (best & low).astype(np.int64)  # anchor of the window that starts at each position
    inside = np.zeros(n + 1, np.int32)
    lens = np.diff(offsets)
    long = lens >= WIDTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - WIDTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(at)]) > 0)
    own = at[starts]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1 if len(first) else first
    return own[first], h[own[first]], np.stack([starts[first], starts[last]], 1)


class Chunk:
    """The anchors of one chunk of documents, in doc_id order, as (doc index, position, hash, start range)."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id")
        order = np.lexsort((np.arange(len(ids)), np.asarray(ids.fill_null(-(2**63)))))
        table = table.take(pa.array(order))
        self.ids = np.asarray(table.column("doc_id").fill_null(-(2**63)))
        self.whole = np.asarray(table.column("copy"))
        self.data, self.offsets = texts_of(table.column("text"))
        parts = []
        for a, b in blocks(self.offsets):
            base = int(self.offsets[a])
            pos, h, spans = anchors(self.data[base : int(self.offsets[b])], self.offsets[a : b + 1] - base)
            parts.append((pos + base, h, spans + base))
        self.pos = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        # anchors are the least hashes of their windows: mixed again, they fill the buckets evenly
        self.hash = mix(np.concatenate([p[1] for p in parts])) if parts else np.zeros(0, np.uint64)
        self.spans = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, 2), np.int64)
        self.doc = np.searchsorted(self.offsets, self.spans[:, 0], "right") - 1
        live = ~self.whole[self.doc] if len(self.doc) else np.zeros(0, bool)
        self.pos, self.hash, self.spans, self.doc = self.pos[live], self.hash[live], self.spans[live], self.doc[live]

    def grouped(self, buckets: int):
        """Distinct anchor hashes by bucket: (hash, number of documents here), and each anchor's index into them."""
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= d[1:] != d[:-1]
        many = np.bincount(group[fresh], minlength=len(first))
        index = np.empty(len(h), np.int64)
        index[order] = group
        distinct = h[first]
        edges = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
        return distinct, many, index, edges


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash space, so that sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def entries_of(chunk: Chunk, index: np.ndarray, shared: np.ndarray):
    """Entries: distinct (neighbourhood, document) of shared anchors, least document of the chunk per neighbourhood.

    Returns for each selected anchor: its bytes key, and ``lead``: whether it is in the least document with this neighbourhood.
    """
    picked = np.flatnonzero(shared[index])
    keys = []
    raw = chunk.data.tobytes()
    docs, lo, hi, pos = chunk.doc[picked].tolist(), chunk.spans[picked, 0].tolist(), chunk.spans[picked, 1].tolist(), chunk.pos[picked].tolist()
    for a, b, p in zip(lo, hi, pos):
        left = p - a
        # suffix from the anchor to the end of the last window; left context reversed; how far the windows reach on both sides
        keys.append((raw[p : b + WIDTH], raw[a:p][::-1], left, p - b))
    least: dict = {}
    for k, d in zip(keys, docs):
        x = least.get(k)
        if x is None or d < x:
            least[k] = d
    return picked, keys, docs, least


def windows_of(chunk: Chunk, index: np.ndarray, hot: np.ndarray):
    """The windows of hot anchors: (start, anchor, doc) of each, its hash's number, and of each number the hash and the first window (of the least document).

    Windows of a chunk are told apart by 64-bit hashes.
    """
    picked = np.flatnonzero(hot[index])
    lo, size = chunk.spans[picked, 0], chunk.spans[picked, 1] - chunk.spans[picked, 0] + 1
    start = expand(lo, size)
    anchor, doc = np.repeat(chunk.pos[picked], size), np.repeat(chunk.doc[picked], size)
    hashes = np.zeros(len(start), np.uint64)
    up, _ = powers(WIDTH)
    for a in range(0, len(start), 1 << 16):
        part = start[a : a + (1 << 16)]
        for j in range(WIDTH):
            hashes[a : a + (1 << 16)] += _BYTE_VALUES[chunk.data[part + j]] * up[j]
    hashes = mix(hashes)
    order = np.lexsort((start, doc, hashes))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return start, anchor, doc, number, h[new], order[new]


def window_keys(raw: bytes, start: np.ndarray, anchor: np.ndarray) -> list[tuple[bytes, bytes, int, int]]:
    """The key of each single window, as those of ``entries_of``."""
    return [(raw[p : s + WIDTH], raw[s:p][::-1], p - s, p - s) for s, p in zip(start.tolist(), anchor.tolist())]


def front_coded(rows: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run: for each row common prefix with the previous suffix, rest, reach, left context and document id."""
    head = struct.Struct("<BBBBq")
    out, last = [], b""
    for suffix, left, near, far, doc in rows:
        n, most = 0, min(len(suffix), len(last))
        if suffix[:most] == last[:most]:
            n = most
        else:
            lo, hi = 0, most
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if suffix[:mid] == last[:mid] else (lo, mid)
            n = lo
        out.append(head.pack(n, len(suffix) - n, near, far, doc))
        out.append(suffix[n:])
        out.append(left)
        last = suffix
    return b"".join(out)


def read_run(data: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(common prefix with the previous row, suffix, left, near, far, doc) of a front-coded run."""
    head, at, last = struct.Struct("<BBBBq"), 0, b""
    while at < len(data):
        n, m, near, far, doc = head.unpack_from(data, at)
        at += head.size
        last = last[:n] + data[at : at + m]
        at += m
        yield n, last, data[at : at + near], near, far, doc
        at += near


def _prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are given."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    x = int.from_bytes(a[known:most], "little") ^ int.from_bytes(b[known:most], "little")
    return known + ((x & -x).bit_length() - 1) // 8


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[int, int, tuple]]:
    """(run, LCP with the row before, row) in suffix order, by a loser tree.

    A contender is [suffix, its common prefix with the last winner, run, row].
    Of two, the one with the longer common prefix is smaller; if these are equal, bytes
    beyond them decide, and the loser keeps the common prefix with the
    winner. Known prefixes are never compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2

    def pull(i: int):
        row = next(runs[i], None) if i < len(runs) else None
        return None if row is None else [row[1], row[0], i, row]

    def play(a, b):
        """(winner, loser); the loser's prefix is then with respect to the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        n = _prefix(a[0], b[0], a[1])
        if a[0][n:] < b[0][n:] or (len(a[0]) == len(b[0]) == n and a[2] < b[2]):
            b[1] = n
            return a, b
        a[1] = n
        return b, a

    tree: list = [None] * k
    level = []
    for i in range(k):
        x = pull(i)
        if x is not None:
            x[1] = 0
        level.append(x)
    size = k
    while size > 1:
        size //= 2
        nxt = []
        for j in range(size):
            w, tree[size + j] = play(level[2 * j], level[2 * j + 1])
            nxt.append(w)
        level = nxt
    winner = level[0]
    while winner is not None:
        yield winner[2], winner[1], winner[3]
        i = winner[2]
        now, node = pull(i), (i + k) // 2
        while node:
            now, tree[node] = play(now, tree[node])
            node //= 2
        winner = now


def resolve(lcp: np.ndarray, suffix_len: np.ndarray, lefts: list[bytes], near: np.ndarray, far: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of each entry: bit a is set if the window that starts a bytes before the anchor is in a smaller document."""
    n = len(lcp)
    mask = np.zeros(n, np.uint32)
    padded = np.frombuffer(b"".join(x.ljust(SPAN, b"\0") for x in lefts), np.uint8).reshape(n, SPAN)
    left = np.zeros(n, np.int64)  # exact number of the left context of a bytes
    for a in range(SPAN + 1):
        if a:
            left = np.unique(left * 256 + padded[:, a - 1], return_inverse=True)[1].reshape(-1)
        need = WIDTH - a
        has = np.flatnonzero((near >= a) & (far <= a) & (suffix_len >= need))
        if len(has) < 2:
            continue
        group = np.cumsum(lcp < need)[has]
        order = np.lexsort((doc[has], left[has], group))
        g, l, d = group[order], left[has][order], doc[has][order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (l[1:] != l[:-1])
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        mask[has[order[d > least]]] |= np.uint32(1 << a)
    return mask


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_MSG = "chunk int, bucket int, kind int, data binary"
_MSG_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], _MSG_ARROW.field(i).type) for i in range(4)], schema=_MSG_ARROW)


def _shared_flags(messages: pa.Table, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared and not hot, hot) for each distinct hash of a chunk, from the buckets' answers of kind 0."""
    shared, hot = np.zeros(n, bool), np.zeros(n, bool)
    for b, kind, data in zip(messages.column("bucket").to_pylist(), messages.column("kind").to_pylist(), messages.column("data").to_pylist()):
        if kind == 0:
            lo, hi = int(edges[b]), int(edges[b + 1])
            both = np.unpackbits(np.frombuffer(data, np.uint8).reshape(2, -1), axis=1, count=hi - lo).astype(bool)
            shared[lo:hi], hot[lo:hi] = both
    return shared & ~hot, hot


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: counts, sha256 of what is left and the removed byte spans (starts, ends)."""
    import zstandard

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    _, n_bytes = text_bytes(picked)
    chunks = chunk_count(n_bytes)
    buckets = max(256, 2 * chunks)  # more than chunks: a task then holds several small ones, evenly
    # copies: same text, first row by doc_id; two 64-bit hashes and the length stand for the text
    order_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    keyed = picked.select("*", F.xxhash64("text").alias("k0"), F.hash("text").alias("k1"), F.octet_length("text").alias("k2"))
    firsts = keyed.groupBy("k0", "k1", "k2").agg(F.min(order_id).alias("first"), F.count(F.lit(1)).alias("n"))
    # written: the join knows its size (a small table is broadcast, so that texts stay where they are), and can be split if a group of copies is large
    leaders = saved(firsts.where("n > 1")).select(F.col("k0").alias("j0"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), "first")
    same = (F.col("k0") == F.col("j0")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))
    flagged = keyed.join(leaders, same, "left").select("doc_id", "text", F.coalesce(order_id > F.col("first"), F.lit(False)).alias("copy"), F.pmod(F.xxhash64("doc_id", "k0"), F.lit(chunks)).cast("int").alias("chunk"))

    def announce(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        me = table.column("chunk")[0].as_py()
        distinct, many, _, edges = c.grouped(buckets)
        rows = []
        for b in range(buckets):
            lo, hi = int(edges[b]), int(edges[b + 1])
            if hi > lo:
                rows.append((me, b, hi - lo, squeeze(distinct[lo:hi], many[lo:hi])))
        return _table(rows)

    def answer(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        who, counts, data = table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist()
        parts = [stretch(x, n, 2) for n, x in zip(counts, data)]
        every, docs_ = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        _, at = np.unique(every, return_inverse=True)
        total = np.bincount(at.reshape(-1), docs_)[at.reshape(-1)]  # documents that have the anchor, in all chunks
        cuts = np.cumsum([0, *counts])
        return _table([(c, b, 0, np.packbits(np.stack([total[i:j] > 1, total[i:j] > hot]), axis=1).tobytes()) for c, i, j in zip(who, cuts, cuts[1:])])

    def send(key, table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        c = Chunk(table)
        me = key[0].as_py()
        distinct, _, index, edges = c.grouped(buckets)
        shared, often = _shared_flags(messages, edges, len(distinct))
        picked, keys, docs_, least = entries_of(c, index, shared)
        by: dict[int, list] = {}
        where = bucket_of(c.hash[picked], buckets).tolist()
        seen = set()
        for k, d, b in zip(keys, docs_, where):
            if least[k] == d and k not in seen:
                seen.add(k)
                by.setdefault(b, []).append((*k, int(c.ids[d])))
        start, anchor, doc, _, h, first = windows_of(c, index, often)
        for k, d, b in zip(window_keys(c.data.tobytes(), start[first], anchor[first]), doc[first].tolist(), bucket_of(h, buckets).tolist()):
            by.setdefault(b, []).append((*k, int(c.ids[d])))
        rows = []
        for b, x in by.items():
            x.sort()
            rows.append((me, b, len(x), zstandard.compress(front_coded(x), 1)))
        return _table(rows)

    def merge(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        who, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
        lcp, run, sizes, lefts, near, far, doc = [], [], [], [], [], [], []
        for r, n, row in merge_runs([read_run(zstandard.decompress(x)) for x in data]):
            run.append(r)
            lcp.append(n)
            sizes.append(len(row[1]))
            lefts.append(row[2])
            near.append(row[3])
            far.append(row[4])
            doc.append(row[5])
        mask = resolve(np.array(lcp), np.array(sizes), lefts, np.array(near), np.array(far), np.array(doc, np.int64))
        run = np.array(run)
        # a run's rows come out in its own order, so its masks are in the order in which it sent them
        return _table([(c, b, 1, zstandard.compress(mask[run == i].tobytes(), 1)) for i, c in enumerate(who)])

    def finish(key, table: pa.Table, messages: pa.Table) -> pa.Table:
        c = Chunk(table)
        n_docs = len(c.ids)
        if not n_docs:
            return _OUT_ARROW.empty_table()
        distinct, _, index, edges = c.grouped(buckets)
        shared, often = _shared_flags(messages, edges, len(distinct))
        picked, keys, docs_, least = entries_of(c, index, shared)
        masks = {b: np.frombuffer(zstandard.decompress(x), np.uint32) for b, kind, x in zip(messages.column("bucket").to_pylist(), messages.column("kind").to_pylist(), messages.column("data").to_pylist()) if kind == 1}
        by: dict[int, set] = {}
        where = bucket_of(c.hash[picked], buckets).tolist()
        for k, b in zip(keys, where):
            by.setdefault(b, set()).add((*k, int(c.ids[least[k]])))
        start, anchor, doc, number, h, first = windows_of(c, index, often)
        single = window_keys(c.data.tobytes(), start[first], anchor[first])
        for k, d, b in zip(single, doc[first].tolist(), bucket_of(h, buckets).tolist()):
            by.setdefault(b, set()).add((*k, int(c.ids[d])))
        mask_of: dict = {}
        for b, x in by.items():
            for k, m in zip(sorted(x), masks[b].tolist()):
                mask_of[k[:4]] = m
        gone = np.zeros(len(c.data) + 1, np.int32)
        low, high = [], []
        for (_, _, near, far), k, d, p in zip(keys, keys, docs_, c.pos[picked].tolist()):
            least_doc = least[k]
            every = (1 << near + 1) - (1 << far)
            m = every if int(c.ids[d]) > int(c.ids[least_doc]) else mask_of[k] & every
            if m == every:  # all windows of the anchor in one span
                low.append(p - near)
                high.append(p - far + WIDTH)
            elif m:
                ones = [p - x for x in range(far, near + 1) if m >> x & 1]
                low += ones
                high += [x + WIDTH for x in ones]
        if low:
            np.add.at(gone, np.array(low, np.int64), 1)
            np.add.at(gone, np.array(high, np.int64), -1)
        if len(start):
            away = np.array([bool(mask_of[k] >> k[2] & 1) for k in single])
            out_of = start[away[number] | (c.ids[doc] > c.ids[doc[first]][number])]
            np.add.at(gone, out_of, 1)
            np.add.at(gone, out_of + WIDTH, -1)
        for i in np.flatnonzero(c.whole).tolist():
            a, b = int(c.offsets[i]), int(c.offsets[i + 1])
            if b - a >= WIDTH:
                gone[a] += 1
                gone[b] -= 1
        lost = np.cumsum(gone[:-1]) > 0
        out = []
        for i in range(n_docs):
            a, b = int(c.offsets[i]), int(c.offsets[i + 1])
            flags = lost[a:b]
            edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
            x, y = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            out.append((b - a, int((y - x).sum()), len(x), hashlib.sha256(c.data[a:b][~flags].tobytes()).hexdigest(), x, y))
        ids = pa.array(c.ids, mask=c.ids == -(2**63))
        return pa.table([ids, *[pa.array([o[j] for o in out], _OUT_ARROW.field(j + 1).type) for j in range(6)]], schema=_OUT_ARROW)

    answers = flagged.groupBy("chunk").applyInArrow(announce, _MSG).groupBy("bucket").applyInArrow(answer, _MSG)
    sent = flagged.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send, _MSG)
    masks = sent.groupBy("bucket").applyInArrow(merge, _MSG)
    return flagged.groupBy("chunk").cogroup(answers.unionByName(masks).groupBy("chunk")).applyInArrow(finish, _OUT)
