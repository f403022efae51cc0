"""Operator 3: scoring with a Brown class-based bigram model.

P(word | word before) = weight * P(class | class before) * P(word | class)
                      + (1 - weight) * (c(word) + 1) / (N + V + 1),
with class transitions and emissions counted over the training part, and
add-``ALPHA`` smoothing of the transitions.  Documents start in the class of the end token.  A word that training does not
have is no member of any class; after it the classes have their shares of all tokens.

Words are lower-cased byte strings named by 64-bit ids; what tasks exchange are packed columns of numbers.

* Counts of all words: each task counts its distinct words and sends them to buckets of the id space; the
  vocabulary, which grows with the corpus, stays in its buckets and is never broadcast or collected.
* Classes of the whole vocabulary by exchange clustering (Kneser and Ney; Martin et al.; distributed as by Uszkoreit and Brants):
  the ``CORE`` most frequent words and the end token are clustered on the driver from their bigram counts, a matrix of at most
  (CORE + 1)^2 cells.  Every other word then has a vector of class counts, of the core words before and after it in the whole
  training part; it stays in the word's bucket.  In each of ``WORD_SWEEPS`` sweeps all buckets move each of their words to the class under
  which its vector and count are likeliest, and the class counts of all words are added up for the next sweep.
  The sweeps' transitions are those of pairs with a core word in them.
* With ``every_pair``, as the query asks for, the model's transitions are counted over all pairs of training tokens, once every word has its class.
* Scoring: chunks of documents ask the buckets for the counts and classes of their distinct words.
* The weight is the one of ``WEIGHTS`` that gives the training documents of one more remainder (``CHECKED``) the highest likelihood, each
  token's own counts left out.

Defined results: null text: one token, the end; no training document: N = V = 0,
every word unknown, base log10(1) each; repeated rows: each is scored (and counted);
null doc_id: not held out, trains; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Words, blocks, chunk_count, saved, squeeze, stretch, text_bytes, texts_of

CORE = 3000
#: Core words are at least 1 in COMMON * CORE tokens, so no more than COMMON * CORE words are ever sorted for them.
COMMON = 64
CLASSES = 64
SWEEPS = 12
WORD_SWEEPS = 3
#: Tasks whose sums of a sweep (32 KB each) are added up at once.
SUMMED = 1024
ALPHA = 0.1
WEIGHTS = tuple(i / 10 for i in range(1, 10))
#: The remainder whose documents choose the weight.
CHECKED = 3
#: Id of the end token; no word has it but by a hash collision.
END = np.uint64(0x0E4D)
#: Bytes of text after which a task sends its counts.
FLUSH_BYTES = 24 << 20
_PIECE = 1 << 21
_ROWS = 128


def _remainder(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7


def held_out(doc_id: str):
    """crc32(doc_id as text) mod 7 is 2."""
    return F.coalesce(_remainder(doc_id) == 2, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, index of each document's first token, with one more) of documents a to b; each ends with END."""
    w = Words(data, offsets, a, b, lower=True)
    ids = w.ids()
    out = np.full(len(ids) + w.n_docs, END, np.uint64)
    keep = np.ones(len(out), bool)
    ends = w.first[1:] + np.arange(w.n_docs)
    keep[ends] = False
    out[keep] = ids
    return out, np.concatenate([[0], ends + 1])


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: exchange clustering of a matrix of unit bigram counts.

    A unit is moved to the class that raises the bigram class likelihood most, until a sweep moves none (or ``sweeps``).
    """
    n = len(bigrams)
    counts = bigrams
    left, right = counts.sum(1, dtype=float), counts.sum(0, dtype=float)
    order = np.argsort(-(left + right), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    to, fro = counts @ member, counts.T @ member  # unit to class, class to unit
    pair = member.T @ to
    rows, cols = member.T @ left, member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            if not left[u] and not right[u]:
                continue
            old, self_ = of[u], float(counts[u, u])
            out, inn = to[u].copy(), fro[u].copy()
            out[old] -= self_
            inn[old] -= self_
            # take u out
            pair[old] -= out
            pair[:, old] -= inn
            pair[old, old] -= self_
            rows[old] -= left[u]
            cols[old] -= right[u]
            # gain of each class: cells (c, d) and (d, c) change by out[d] and inn[d]
            base = f(pair)
            gain = (f(pair + out[None, :]) - base).sum(1) + (f(pair + inn[:, None]) - base).sum(0)
            diag = np.diagonal(pair)
            gain += f(diag + out + inn + self_) - f(diag + out) - f(diag + inn) + f(diag)
            gain -= f(rows + left[u]) - f(rows) + f(cols + right[u]) - f(cols)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            pair[new] += out
            pair[:, new] += inn
            pair[new, new] += self_
            rows[new] += left[u]
            cols[new] += right[u]
            if new != old:
                moved += 1
                of[u] = new
                to[:, old] -= counts[:, u]
                to[:, new] += counts[:, u]
                fro[:, old] -= counts[u]
                fro[:, new] += counts[u]
        if not moved:
            break
    return of


def places(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each id in the sorted ``among``, -1 where it is not there."""
    if not len(among):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(among, ids), len(among) - 1)
    return np.where(among[at] == ids, at, -1)


def buckets_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """First index of each bucket in sorted words, with one more: buckets are ranges of the id space."""
    return np.searchsorted(((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))


def pairs_of(cls: np.ndarray, first: np.ndarray, end: int, k: int) -> np.ndarray:
    """class before * k + class of all tokens that have a class, as has the one before; documents start in the class ``end``."""
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    before[first[:-1]] = end
    both = (cls >= 0) & (before >= 0)
    return (before * k + cls)[both]


_PART = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_PART_DDL = "bucket int, n int, data binary"
_MESSAGE = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_MESSAGE_DDL = "chunk int, bucket int, n int, data binary"


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _gathered(kernel, send):
    """A function over Arrow batches of texts: ``kernel`` gives arrays for a piece of documents, ``send`` rows for all arrays of about FLUSH_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            for a, b in blocks(offsets, _PIECE):
                held.append(kernel(*tokens(data, offsets, a, b)))
                size += int(offsets[b] - offsets[a])
                if size >= FLUSH_BYTES:
                    yield from _table(_PART, send([np.concatenate(x) for x in zip(*held)])).to_batches()
                    held, size = [], 0
        if held:
            yield from _table(_PART, send([np.concatenate(x) for x in zip(*held)])).to_batches()

    return run


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_counts=True)


def _merged(table: pa.Table, k: int) -> list[np.ndarray]:
    """The packed columns of all rows, end to end."""
    parts = [stretch(x, n, k) for n, x in zip(table.column("n").to_pylist(), table.column("data").to_pylist())]
    return [np.concatenate([p[i] for p in parts]) for i in range(k)]


class Model:
    """Class transitions and masses, and the assignment of words by their class-count vectors."""

    def __init__(self, moves: np.ndarray, mass: np.ndarray):
        self.moves, self.mass, self.k = moves, mass, len(mass)
        self.rows = moves.sum(1)
        self.transition = (moves + ALPHA) / (self.rows[:, None] + ALPHA * self.k)
        self.share = (mass + ALPHA) / (mass.sum() + ALPHA * self.k)

    def classes(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The class of each word: the one under which its neighbours (classes before, then classes after) and its own tokens are likeliest."""
        log = np.log(self.transition)
        score = vectors[:, : self.k] @ log + vectors[:, self.k :] @ log.T
        n = counts[:, None].astype(float)
        score -= n * np.log(self.mass[None, :] + n)
        # a word without any core neighbour goes by the shares of the classes
        score[~vectors.any(1)] = np.log(self.share)
        return score.argmax(1)


def _vocabulary(table: dict | pa.Table, core: np.ndarray, core_class: np.ndarray, k: int):
    """(words, counts, vectors, class of the core words and -1 for others) of a bucket's row."""
    n, m = table["n"], table["m"]
    words, counts = stretch(table["data"], n, 2) if n else (np.zeros(0, np.uint64),) * 2
    vectors = np.zeros((n, 2 * k))
    if m:
        word, code, times = (x.view(np.int64) for x in stretch(table["vectors"], m, 3))
        vectors[word, code] = times
    at = places(words, core)
    return words, counts.view(np.int64), vectors, np.where(at >= 0, core_class[at] if len(core_class) else -1, -1)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every_pair: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document.

    ``every_pair``: transitions are counted over all pairs of training tokens, not just those with a core word in them.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), held_out(doc_id).alias("held_out"), F.coalesce(_remainder(doc_id) == CHECKED, F.lit(False)).alias("checked"))
    _, n_bytes = text_bytes(picked)
    chunks = chunk_count(n_bytes)
    buckets = chunks
    train = picked.where("not held_out").select("text")

    def by_word(columns) -> list[tuple]:
        """Rows of packed columns, the first of which is sorted words."""
        edge = buckets_of(columns[0], buckets).tolist()
        return [(i, b - a, squeeze(*[x[a:b] for x in columns])) for i, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]

    def total(table: pa.Table) -> pa.Table:
        words, n = _merged(table, 2)
        words, at = np.unique(words, return_inverse=True)
        counts = np.bincount(at.reshape(-1), n.astype(np.int64)).astype(np.int64)
        return _table(_PART, [(table.column("bucket")[0].as_py(), len(words), squeeze(words, counts))])

    count = _gathered(lambda ids, first: (ids,), lambda x: by_word(_counted(x[0])))
    vocabulary = saved(train.mapInArrow(count, _PART_DDL).groupBy("bucket").applyInArrow(total, _PART_DDL))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(stretch(r["data"], r["n"], 2)[1].sum()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int64()), batch.column(1).cast(pa.int64())], names=["n", "v"])

    whole = vocabulary.mapInArrow(sizes, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_train, n_words = whole["n"], whole["v"]

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = stretch(r["data"], r["n"], 2)
                keep = (counts * np.uint64(COMMON * CORE) >= np.uint64(n_train)) & (words != END)
                yield pa.RecordBatch.from_arrays([pa.array(words[keep].view(np.int64)), pa.array(counts[keep].view(np.int64))], names=["word", "c"])

    top = vocabulary.mapInArrow(common, "word long, c long").orderBy(F.desc("c"), "word").limit(CORE).select("word").collect()
    core = np.sort(np.append(np.array([r["word"] for r in top], np.int64).view(np.uint64), END))
    end, u = int(np.searchsorted(core, END)), len(core)

    def pair_keys(ids: np.ndarray, first: np.ndarray):
        unit = places(ids, core)
        before = np.empty_like(unit)
        before[1:] = unit[:-1]
        before[first[:-1]] = end  # a document follows an end
        both = (unit >= 0) & (before >= 0)
        return ((before * u + unit)[both].astype(np.uint64),)

    def by_rows(columns) -> list[tuple]:
        edge = np.searchsorted(columns[0], np.arange(0, u + _ROWS, _ROWS).astype(np.uint64) * np.uint64(u)).tolist()
        return [(i, b - a, squeeze(*[x[a:b] for x in columns])) for i, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]

    def matrix(table: pa.Table) -> pa.Table:
        i = table.column("bucket")[0].as_py()
        key, n = (x.view(np.int64) for x in _merged(table, 2))
        cells = np.bincount(key - i * _ROWS * u, n, _ROWS * u).astype(np.float32)
        return _table(_PART, [(i, 0, zstandard.compress(cells.tobytes(), 1))])

    pairs = train.mapInArrow(_gathered(pair_keys, lambda x: by_rows(_counted(x[0]))), _PART_DDL).groupBy("bucket").applyInArrow(matrix, _PART_DDL)
    bigrams = np.zeros((-(-u // _ROWS) * _ROWS, u), np.float32)
    for r in pairs.collect():
        bigrams[r["bucket"] * _ROWS : (r["bucket"] + 1) * _ROWS] = np.frombuffer(zstandard.decompress(r["data"]), np.float32).reshape(_ROWS, u)
    bigrams = bigrams[:u]
    core_class = exchange(bigrams, min(CLASSES, u))
    k = int(core_class.max()) + 1
    member = np.zeros((u, k), np.float32)
    member[np.arange(u), core_class] = 1
    core_moves = member.T.astype(float) @ (bigrams @ member)
    model = Model(core_moves, np.maximum(core_moves.sum(0), 1.0))
    del bigrams

    def neighbours(ids: np.ndarray, first: np.ndarray):
        at = places(ids, core)
        cls = np.where(at >= 0, core_class[at], -1)
        rest = np.flatnonzero(at < 0)
        start = np.zeros(len(ids), bool)
        start[first[:-1]] = True
        before = np.where(start[rest], core_class[end], cls[rest - 1])
        after = cls[rest + 1] + k  # the end is always there
        word = np.concatenate([ids[rest], ids[rest]])
        code = np.concatenate([before, after])
        known = np.concatenate([before >= 0, after >= k])
        return word[known], code[known]

    def vectors_of(columns) -> list[tuple]:
        word, code = columns
        order = np.lexsort((code, word))
        word, code = word[order], code[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(new)
        return by_word([word[at], code[at].astype(np.uint64), np.diff(np.append(at, len(word))).astype(np.uint64)])

    whole_schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("m", pa.int32()), ("vectors", pa.binary())])

    def joined(key, table: pa.Table, around: pa.Table) -> pa.Table:
        if not table.num_rows:
            return whole_schema.empty_table()
        own = table.to_pylist()[0]
        m, data = 0, b""
        if around.num_rows:
            words = stretch(own["data"], own["n"], 2)[0]
            word, code, times = _merged(around, 3)
            cell, at = np.unique(np.searchsorted(words, word) * 2 * k + code.astype(np.int64), return_inverse=True)
            times = np.bincount(at.reshape(-1), times.astype(np.int64)).astype(np.int64)
            m, data = len(cell), squeeze(cell // (2 * k), cell % (2 * k), times)
        return _table(whole_schema, [(own["bucket"], own["n"], own["data"], m, data)])

    sent = train.mapInArrow(_gathered(neighbours, vectors_of), _PART_DDL)
    words = saved(vocabulary.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(joined, "bucket int, n int, data binary, m int, vectors binary"))

    def sweep(now: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves, mass = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                for r in batch.to_pylist():
                    _, counts, vectors, cls = _vocabulary(r, core, core_class, k)
                    free = cls < 0
                    cls[free] = now.classes(vectors[free], counts[free])
                    for c in range(k):
                        own = free & (cls == c)
                        moves[:, c] += vectors[own, :k].sum(0)
                        moves[c] += vectors[own, k:].sum(0)
                    mass += np.bincount(cls, counts, k)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([moves.ravel(), mass]).tobytes()], pa.binary())], names=["sums"])

        return run

    def add(table: pa.Table, cells: int) -> pa.Table:
        every = np.zeros(cells)
        for x in table.column("sums").to_pylist():
            every += np.frombuffer(x, np.float64)
        return pa.table([pa.array([every.tobytes()], pa.binary())], names=["sums"])

    for _ in range(WORD_SWEEPS):
        sums = np.zeros(k * k + k)
        # one job: the sums of neighbouring tasks are added up by tasks, and the few that are left here
        parts = words.mapInArrow(sweep(model), "sums binary").select(F.expr(f"spark_partition_id() div {SUMMED}").alias("few"), "sums")
        for r in parts.groupBy("few").applyInArrow(lambda x: add(x, k * k + k), "sums binary").collect():
            sums += np.frombuffer(r["sums"], np.float64)
        last, model = model, Model(core_moves + sums[: k * k].reshape(k, k), np.maximum(sums[k * k :], 1.0))

    grouped = picked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).groupBy("chunk")

    def distinct(table: pa.Table) -> np.ndarray:
        data, offsets = texts_of(table.column("text"))
        parts = [np.unique(tokens(data, offsets, a, b)[0]) for a, b in blocks(offsets, _PIECE)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def ask(table: pa.Table) -> pa.Table:
        me = table.column("chunk")[0].as_py()
        return _table(_MESSAGE, [(me, *row) for row in by_word([distinct(table)])])

    def answer(key, asked: pa.Table, own: pa.Table) -> pa.Table:
        held, counts, cls = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        if own.num_rows:
            held, counts, vectors, cls = _vocabulary(own.to_pylist()[0], core, core_class, k)
            free = cls < 0
            cls[free] = last.classes(vectors[free], counts[free])  # as in the last sweep, whose sums are the model
        rows = []
        for r in asked.to_pylist():
            at = places(stretch(r["data"], r["n"], 1)[0], held)
            known = at >= 0
            c, x = (np.where(known, y[at], z) if len(held) else np.full(len(at), z) for y, z in ((counts, 0), (cls, -1)))
            rows.append((r["chunk"], r["bucket"], r["n"], squeeze(c, x + 1)))
        return _table(_MESSAGE, rows)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("scores", pa.list_(pa.float64())), ("checks", pa.list_(pa.float64()))])
    def looked_up(table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of a chunk, their counts, their classes)."""
        known = distinct(table)
        edge = buckets_of(known, buckets)
        c, cls = np.zeros(len(known), np.int64), np.full(len(known), -1)
        for b, n, data in zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column("data").to_pylist()):
            got = [x.view(np.int64) for x in stretch(data, n, 2)]
            c[edge[b] : edge[b + 1]], cls[edge[b] : edge[b + 1]] = got[0], got[1] - 1
        return known, c, cls

    def passed(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Class transitions of a chunk's training tokens."""
        moves = np.zeros(k * k)
        if table.num_rows:
            known, _, cls = looked_up(table, answers)
            table = table.filter(pa.compute.invert(table.column("held_out")))
            data, offsets = texts_of(table.column("text"))
            for a, b in blocks(offsets, _PIECE):
                ids, first = tokens(data, offsets, a, b)
                moves += np.bincount(pairs_of(cls[np.searchsorted(known, ids)], first, core_class[end], k), minlength=k * k)
        return pa.table([pa.array([moves.tobytes()], pa.binary())], names=["sums"])

    answers = grouped.applyInArrow(ask, _MESSAGE_DDL).groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(answer, _MESSAGE_DDL)
    if every_pair:
        answers = saved(answers)  # read by both passes
        moves = np.zeros(k * k)
        parts = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(passed, "sums binary").select(F.expr(f"spark_partition_id() div {SUMMED}").alias("few"), "sums")
        for r in parts.groupBy("few").applyInArrow(lambda x: add(x, k * k), "sums binary").collect():
            moves += np.frombuffer(r["sums"], np.float64)
        model = Model(moves.reshape(k, k), model.mass)
    # the row after the last is that of words without a class
    transition = np.vstack([model.transition, model.share])
    emission = np.append(model.mass, 1.0)

    def judge(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        known, c, cls = looked_up(table, answers)
        data, offsets = texts_of(table.column("text"))
        checked = np.asarray(table.column("checked"))
        out: list[list] = [[] for _ in range(4)]
        checks: list[list | None] = []
        for a, b in blocks(offsets, _PIECE):
            ids, first = tokens(data, offsets, a, b)
            at = np.searchsorted(known, ids)
            n, own = c[at], cls[at]
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[first[:-1]] = core_class[end]
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731
            plain = (n + 1) / (n_train + n_words + 1)
            classed = transition[before, own] * (n / emission[own])
            out[0].append(np.diff(first))
            out[1].append(add((n > 0).astype(np.int64)))
            out[2].append(add(np.log10(plain)))
            out[3].append(np.stack([add(np.log10(w * classed + (1 - w) * plain)) for w in WEIGHTS], 1))
            checks += [None] * (b - a)
            inside = np.repeat(checked[a:b], np.diff(first))
            if inside.any():
                n, own, before, doc = n[inside], own[inside], before[inside], np.repeat(np.arange(b - a), np.diff(first))[inside]
                less = np.maximum(model.moves[before, own] - 1, 0) + ALPHA
                classed = less / (np.maximum(model.rows[before] - 1, 0) + ALPHA * k) * ((n - 1) / np.maximum(emission[own] - 1, 1))
                plain = n / (n_train + n_words)
                left = np.stack([np.bincount(doc, np.log10(w * classed + (1 - w) * plain), b - a) for w in WEIGHTS], 1)
                for d in np.flatnonzero(checked[a:b]).tolist():
                    checks[d - b] = left[d].tolist()
        n, known_, base, scores = (np.concatenate(x) for x in out)
        return pa.table([table.column("doc_id"), table.column("held_out"), n, known_, base, pa.array(scores.tolist(), pa.list_(pa.float64())), pa.array(checks, pa.list_(pa.float64()))], schema=schema)

    scored = saved(grouped.cogroup(answers.groupBy("chunk")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, checks array<double>"))
    fit = scored.where("checks is not null").agg(*[F.sum(F.col("checks")[i]).alias(f"w{i}") for i in range(len(WEIGHTS))]).first()
    best = max(range(len(WEIGHTS)), key=lambda i: (fit[i] is not None, fit[i] or 0.0, -i))
    own = F.col("scores")[best]
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", own.alias("score"), F.pow(F.lit(10.0), -own / F.col("n_tokens")).alias("perplexity"), F.lit(WEIGHTS[best]).alias("weight"))
