"""Operator 6: benchmark decontamination by latent semantic retrieval.

1.  Terms: lower-cased runs of letters and digits, in scripts without spaces (Han, kana, Thai, ...) single signs, hashed to ``TERMS`` buckets.
    Document frequencies are counted over the passages (``PASSAGE`` terms) of all documents.
2.  Distributed randomised SVD of the passage-term TF-IDF matrix A: every task adds up its part
    of Z = A'(A O) for a Gaussian O; the sum has TERMS x SKETCH cells at any corpus
    size.  The driver gets the right singular vectors by the Nystrom step
    V S = Z (O'Z)^(-1/2).
3.  Every window of every document (lengths of about an item's, a quarter apart) is projected
    and whitened, weak components less than fully (in a small corpus they tell near copies apart); windows with a cosine of
    ``COSINE`` to an item are candidates.
4.  A candidate must share enough of the item's words (an upper bound of the next step, counted for all windows and items at
    once and so applied before the cosine), and be a peak of shared words among the windows around it; then the longest common
    subsequence of the item and the surroundings decides: a share of ``LCS_SURE`` of
    the item, or of ``LCS_LIKELY`` with half of the item's answer (its last quarter) in it as well.

The items are a stated query set, handled in blocks of ``ITEM_BLOCK`` against all rows.

Defined results: null or wordless texts match nothing, nor do null or wordless items; repeated
rows and items: each pair is returned; empty tables: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Words, blocks, text_bytes, texts_of, unused_prefix

TERMS = 1 << 14  # the top 14 bits of a word id
PASSAGE = 48
SKETCH = 40
CELL = 8
LENGTHS = (16, 32, 48, 64)
COSINE = 0.3  # the cosine of a text with LCS_LIKELY of the words, half a step off, less the noise of the sketch
LCS_SURE, LCS_LIKELY, ANSWER = 0.8, 0.6, 0.5
ITEM_BLOCK = 4000
SUMMED = 1024  # tasks whose parts of the sketch are added up at once
ITEMS_AT_ONCE = 256
TASK_BYTES = 64 << 20
_SEED = 6
_PIECE = 1 << 19
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[b for b in range(128) if not (chr(b).isalnum())]] = 32


def terms(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word id, term bucket, index of each document's first word, with one more)."""
    w = Words(_CLEAN[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], signs=True)
    ids = w.ids()
    return ids, (ids >> np.uint64(50)).astype(np.int32), w.first


def passages(first: np.ndarray) -> np.ndarray:
    """Passage number of each word; no passage crosses documents."""
    count = np.diff(first)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], count)
    per = -(-count // PASSAGE)
    return np.repeat(np.cumsum(per) - per, count) + inside // PASSAGE


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Passages that hold each term bucket, and at the end the number of passages."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            for a, b in blocks(offsets, _PIECE):
                _, term, first = terms(data, offsets, a, b)
                if len(term):
                    passage = passages(first)
                    key = np.sort((passage * TERMS + term).astype(np.uint64))
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                    held += np.bincount((key % np.uint64(TERMS)).astype(np.int64), minlength=TERMS + 1)
                    held[-1] += passage[-1] + 1
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(held[cell])], schema=schema)

    found = docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1)
    out[found["term"]] = found["n"]
    return out


def singular_vectors(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Whitened right singular vectors (TERMS x SKETCH) of the TF-IDF matrix, by one pass over all passages."""
    random = np.random.default_rng(_SEED).normal(size=(TERMS, SKETCH)).astype(np.float32)
    # one contiguous column per component: it stays in the cache while all terms of a block look it up
    weighted = np.ascontiguousarray((random * idf[:, None].astype(np.float32)).T)
    squares = idf**2
    step = TERMS // 32
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((SKETCH, TERMS), np.float64)
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            for a, b in blocks(offsets, _PIECE):
                _, term, first = terms(data, offsets, a, b)
                if not len(term):
                    continue
                passage = passages(first)
                starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                size = np.diff(np.append(starts, len(term)))
                scale = 1 / np.maximum(np.add.reduceat(squares[term], starts), 1e-9)
                for j in range(SKETCH):
                    y = np.add.reduceat(weighted[j][term], starts) * scale
                    held[j] += np.bincount(term, np.repeat(y, size), minlength=TERMS)
        held *= idf[None, :]
        if held.any():
            out = np.ascontiguousarray(held.T.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array([out[i * step : (i + 1) * step].tobytes() for i in range(32)], pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("data").to_pylist())
        return pa.table([table.column("part").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], schema=schema)

    z = np.zeros((TERMS, SKETCH))
    # parts of neighbouring tasks first: no group holds those of all tasks
    parts = docs.mapInArrow(run, "part int, data binary").withColumn("few", F.expr(f"spark_partition_id() div {SUMMED}"))
    few = parts.groupBy("few", "part").applyInArrow(add, "part int, data binary")
    for r in few.groupBy("part").applyInArrow(add, "part int, data binary").collect():
        z[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["data"], np.float32).reshape(step, SKETCH)
    core = random.T.astype(np.float64) @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value.max(), 0) * 1e-9
    if not keep.any():
        return np.zeros((TERMS, 1), np.float32)
    u, s, _ = np.linalg.svd(z @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    good = s > s[0] * 1e-6
    return (u[:, good] / np.hypot(s[good], s[good].mean()) * idf[:, None]).astype(np.float32)


def lcs(region: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of ``region`` and an item of ``n`` words, whose places ``masks`` holds (bit-parallel)."""
    every, row = (1 << n) - 1, (1 << n) - 1
    for t in region:
        m = masks.get(t)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & every
    return n - row.bit_count()


def window_lengths(longest: int) -> list[int]:
    """``LENGTHS``, carried on in steps of a half or a third up to the longest item."""
    out = list(LENGTHS)
    while out[-1] < longest:
        out.append(out[-2] * 2)
    return out


class Items:
    """A block of items, ready for the search."""

    def __init__(self, ids: list, texts: list[bytes], vectors: np.ndarray):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        word, term, first = terms(np.frombuffer(b"".join(texts), np.uint8), offsets, 0, len(texts))
        self.ids, self.words, self.masks, self.answers, self.terms = ids, [], [], [], []
        self.member = np.zeros((len(ids), TERMS + 1), np.uint8)
        latent = np.zeros((len(ids), vectors.shape[1]), np.float32)
        for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            own = word[a:b].tolist()
            masks: dict[int, int] = {}
            tail: dict[int, int] = {}
            start = max(0, len(own) - max(3, -(-len(own) // 4)))
            for j, t in enumerate(own):
                masks[t] = masks.get(t, 0) | 1 << j
                if j >= start:
                    tail[t] = tail.get(t, 0) | 1 << (j - start)
            self.words.append(own)
            self.masks.append(masks)
            self.answers.append((tail, len(own) - start))
            self.member[i, term[a:b]] = 1
            if b > a:
                latent[i] = vectors[term[a:b]].sum(0)
        norm = np.linalg.norm(latent, axis=1)
        self.latent = latent / np.maximum(norm, 1e-12)[:, None]
        self.size = np.diff(first)
        self.sizes, self.sets = self.size.tolist(), [set(m) for m in self.masks]
        self.lengths = window_lengths(int(self.size.max(initial=0)))
        lengths = np.array(self.lengths)
        self.kind = np.abs(lengths[None, :] - self.size[:, None]).argmin(1)
        self.kind[norm == 0] = -1
        # a window longer than the item holds other words too, one shorter lacks some of its words
        share = self.size / lengths[self.kind]
        by_kind = {k: np.flatnonzero(self.kind == k) for k in range(len(lengths))}
        #: for each window length, (items, their member columns), a few at a time
        self.parts = {k: [(few, np.ascontiguousarray(self.member[few].T)) for few in (own[x : x + ITEMS_AT_ONCE] for x in range(0, len(own), ITEMS_AT_ONCE))] for k, own in by_kind.items()}
        self.least = COSINE * np.sqrt(np.minimum(share, 1 / np.maximum(share, 1e-9))).astype(np.float32)


def peaks(doc: np.ndarray, item: np.ndarray, start: np.ndarray, common: np.ndarray, radius: int) -> np.ndarray:
    """The windows that have more common words than any other of the same document and item within ``radius`` cells,
    and those without such a window within ``radius``: the region around a peak holds that of the windows beside it."""
    order = np.lexsort((start, item, doc))
    doc, item, start, common = doc[order], item[order], start[order], common[order]
    n = len(order)
    top, beside = np.ones(n, bool), np.zeros(n, bool)
    pairs = []
    for r in range(1, radius + 1):
        a = np.flatnonzero((doc[r:] == doc[:-r]) & (item[r:] == item[:-r]) & (start[r:] - start[:-r] <= radius)) if n > r else np.zeros(0, np.int64)
        b = a + r
        pairs.append((a, b))
        top[a[common[b] > common[a]]] = False
        top[b[common[a] >= common[b]]] = False
    for a, b in pairs:
        beside[a[top[b]]] = True
        beside[b[top[a]]] = True
    return order[top | ~beside]


def matches(word: np.ndarray, term: np.ndarray, first: np.ndarray, items: Items, vectors: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
    """(document, item, cosine, LCS, answer LCS, first word of the region): the best region of each pair."""
    count = np.diff(first)
    cells = -(-count // CELL)
    cell_first = np.concatenate([[0], np.cumsum(cells)])
    slots = np.full(cell_first[-1] * CELL, TERMS, np.int32)
    slots[np.arange(len(term)) - np.repeat(first[:-1] - cell_first[:-1] * CELL, count)] = term
    sums = np.zeros((cell_first[-1] + 1, vectors.shape[1]))
    columns = slots.reshape(-1, CELL).T
    cell = vectors[columns[0]]
    for own in columns[1:]:
        cell += vectors[own]
    np.cumsum(cell, axis=0, dtype=np.float64, out=sums[1:])
    best: dict[tuple[int, int], tuple] = {}
    text = word.tolist()
    for kind, length in enumerate(items.lengths):
        if not items.parts[kind]:
            continue
        span = length // CELL
        step = max(1, span // 4)
        per = np.where(cells > 0, 1 + np.maximum(0, -(-(cells - span) // step)), 0)
        doc = np.repeat(np.arange(len(count)), per)
        start = cell_first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * step
        end = np.minimum(start + span, cell_first[1:][doc])
        latent = (sums[end] - sums[start]).astype(np.float32)
        latent /= np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent)), 1e-12)[:, None]
        near = []
        for few, member in items.parts[kind]:
            # words of each cell that the item has, as prefix sums; the item may reach over a window's ends by a quarter
            held = np.zeros((len(columns[0]) + 1, len(few)), np.int32)
            cell_held = member[columns[0]]
            for c in columns[1:]:
                cell_held += member[c]
            np.cumsum(cell_held, axis=0, out=held[1:])
            enough = np.ceil((LCS_LIKELY - 0.25) * items.size[few] - 1e-9).astype(np.int32)
            target, least = items.latent[few].T, items.least[few]
            for low in range(0, len(doc), 1 << 13):
                part = slice(low, low + (1 << 13))
                cosine = latent[part] @ target
                shared = held[end[part]] - held[start[part]]
                w, j = np.nonzero((cosine >= least) & (shared >= enough))
                if len(w):
                    near.append((w + low, few[j], cosine[w, j], shared[w, j]))
        if not near:
            continue
        w, item, score, common = (np.concatenate(x) for x in zip(*near))
        x = peaks(doc[w], item, start[w], common, max(1, span // 3))
        d = doc[w[x]]
        at = (start[w[x]] - cell_first[d]) * CELL
        low, high = np.maximum(0, at - length // 2 - CELL), np.minimum(count[d], at + length + length // 2 + CELL)
        for d, i, a, b, base, own_score in zip(d.tolist(), item[x].tolist(), low.tolist(), high.tolist(), first[d].tolist(), score[x].tolist()):
            region, masks, n = text[base + a : base + b], items.masks[i], items.sizes[i]
            there = items.sets[i].intersection(region)
            if len(there) + n - len(masks) < LCS_LIKELY * n or sum(masks[t].bit_count() for t in there) < LCS_LIKELY * n:
                continue
            common_n = lcs(region, masks, n)
            if common_n < LCS_LIKELY * n:
                continue
            tail, tail_n = items.answers[i]
            answer = lcs(region, tail, tail_n)
            if common_n >= LCS_SURE * n or answer >= ANSWER * tail_n:
                now = (common_n, answer, own_score, -a)
                if now > best.get((d, i), (-1,)):
                    best[d, i] = now
    return [(d, i, s, n, t, -a) for (d, i), (n, t, s, a) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, answer_lcs, start_word): one row for each document and item that it leaks."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    _, n_bytes = text_bytes(picked)
    # few tasks keep what the sketch sends small against the input
    narrow = picked.select("text").coalesce(max(12, -(-n_bytes // TASK_BYTES)))
    df = document_frequencies(narrow)
    idf = np.log1p(df[-1] / np.maximum(df[:-1], 1))  # positive for terms of all passages, too
    vectors = singular_vectors(narrow, idf)
    table = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int32()), ("item_words", pa.int32()), ("answer_lcs", pa.int32()), ("start_word", pa.int32())])
    ddl = "doc_id long, item_id long, cosine double, lcs int, item_words int, answer_lcs int, start_word int"

    def search(rows: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items([r["id"] for r in rows], [bytes(r["text"]) for r in rows], table[:-1])
            for batch in batches:
                data, offsets = texts_of(batch.column(1))
                for a, b in blocks(offsets, _PIECE):
                    word, term, first = terms(data, offsets, a, b)
                    found = matches(word, term, first, items, table) if len(word) else []
                    if found:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + x[0] for x in found])), pa.array([items.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found]), pa.array([x[3] for x in found], pa.int32()), pa.array([int(items.size[x[1]]) for x in found], pa.int32()), pa.array([x[4] for x in found], pa.int32()), pa.array([x[5] for x in found], pa.int32())], schema=schema)

        return run

    queries = benchmark.select(F.col(item_id).cast("long").alias("id"), F.encode(F.coalesce(F.col(item_text).cast("string"), F.lit("")), "utf-8").alias("text"))
    out, held = None, []
    stream = queries.toLocalIterator()
    while True:
        held = [r for _, r in zip(range(ITEM_BLOCK), stream)]
        if not held and out is not None:
            return out
        part = picked.mapInArrow(search(held), ddl)
        out = part if out is None else out.unionByName(part)
        if len(held) < ITEM_BLOCK:
            return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with the columns that they came with.

    Rows are told apart by a hash of doc_id and text, so rows that share a doc_id, or have none, are judged one by one.
    """
    own = unused_prefix(docs)
    marked = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    leaks = contaminated(marked, benchmark, doc_id=own).select(F.col("doc_id").alias(f"{own}leak")).distinct()
    return marked.join(leaks, F.col(own) == F.col(f"{own}leak"), "left_anti").drop(own)
