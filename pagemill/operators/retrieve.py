"""Retrieval: dense, BM25 and fused rankings, neighbour bleed, structure-chunk search.

Rankings are long rows (qid, doc_id, page_num, score, rank).  A stated query set
(in blocks of ``QUERY_BYTES``) meets all pages, and a task keeps and sends on its best k per query only,
ties included, so what is shuffled is k rows per query and task, whatever the number of pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import dot, tokens
from pagemill.session import bounded_batches
from pagemill.sources.scratch import scratch_path, written

#: Bytes of queries that meet all pages in one scan.
QUERY_BYTES = 32 << 20
#: Rows and queries of one matrix of scores, and its most cells (4 MB).
ROWS, COLUMNS, CELLS = 2000, 250, 500_000
K1, B, EPSILON = 1.5, 0.75, 0.25


def top_k(scored: DataFrame, k: int, by: str = "qid", *ties: Column) -> DataFrame:
    """Best k rows of each query; equal scores (to 9 digits) by ``ties``, else doc and page."""
    order = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), *(ties or (F.col("doc_id"), F.col("page_num"))))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, size) -> Iterator[list]:
    """The queries' rows in blocks of about ``QUERY_BYTES``; ``size``: bytes of a row."""
    held, total = [], 0
    for row in queries.toLocalIterator():
        held.append(row)
        total += size(row)
        if total >= QUERY_BYTES:
            yield held
            held, total = [], 0
    yield held


_RANKED = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("page_num", pa.int64()), ("score", pa.float64())])
_RANKED_DDL = "qid long, doc_id long, page_num long, score double"


class Best:
    """The best k (score, then doc and page) of each of ``n`` queries among all the scores that a task has seen."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.size = n, k, 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        #: The score that a row needs to be among the best k so far.
        self.floor = np.full(n, -np.inf)

    def add(self, low: int, score: np.ndarray, doc: np.ndarray, page: np.ndarray) -> None:
        """Scores of (row, query ``low`` + column), which are rounded in place; rows in the order of doc and page; -inf is no score."""
        np.round(score, 9, out=score)
        m, width = score.shape
        keep = np.isfinite(score) & (score >= self.floor[low : low + width])
        if m > self.k and np.count_nonzero(keep) > self.k * width:
            least = np.partition(score, m - self.k, axis=0)[m - self.k].copy()
            above, level = score > least, score == least
            # of rows at the least score the first ones stay, so that a query never has more than k
            keep &= above | (level & (np.cumsum(level, axis=0, dtype=np.int32) <= self.k - above.sum(0)))
        row, q = np.nonzero(keep)
        self.parts.append((q + low, -score[row, q], doc[row], page[row]))
        self.size += len(q)
        if self.size > 2 * self.n * self.k + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        q, score, doc, page = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * 2)
        order = np.lexsort((page, doc, score, q))
        start = np.searchsorted(q[order], np.arange(self.n))
        order = order[np.arange(len(order)) - start[q[order]] < self.k]
        self.parts = [(q[order], score[order], doc[order], page[order])]
        self.size = len(order)
        full = np.bincount(q[order], minlength=self.n) == self.k
        last = np.cumsum(np.bincount(q[order], minlength=self.n)) - 1
        self.floor[full] = -score[order][last[full]]
        return self.parts[0]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        q, score, doc, page = self.cut()
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(doc), pa.array(page), pa.array(-score)], schema=_RANKED)


def _in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc, page = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    return batch.take(pa.array(np.lexsort((page, doc))))


def _joined(pages: DataFrame, blocks: Iterator[list], scorer) -> DataFrame:
    """What all tasks send on for all blocks of queries."""
    bounded_batches(pages.sparkSession)
    out = None
    for block in blocks:
        part = pages.mapInArrow(scorer(block), _RANKED_DDL) if block else pages.sparkSession.createDataFrame([], _RANKED_DDL)
        out = part if out is None or not block else out.unionByName(part)
    return out


def _ranked(pages: DataFrame, blocks: Iterator[list], scorer, k: int) -> DataFrame:
    """Best k of all blocks of queries; every task sends on at most k rows a query."""
    return top_k(_joined(pages, blocks, scorer), k)


def dense_topk(pages: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """D3, D4 (rows without a vector are left out): inner products of ``queries`` (qid long, emb) with all ``pages`` (doc_id long, page_num long, emb), best k."""

    def scorer(rows: list):
        # arrays, not rows: what a worker gets is 8 bytes a number
        ids, matrix = np.array([r["qid"] for r in rows], np.int64), np.array([r["emb"] for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = _in_order(batch.slice(low, ROWS))
                    doc, page = np.asarray(part.column(0)), np.asarray(part.column(1))
                    emb = np.asarray(part.column(2).flatten(), np.float64).reshape(part.num_rows, -1)
                    for q in range(0, len(ids), COLUMNS):
                        score = emb @ matrix[q : q + COLUMNS].T
                        if exclude_self:
                            score[page[:, None] == ids[None, q : q + COLUMNS]] = -np.inf
                        best.add(q, score, doc, page)
            yield best.rows(ids)

        return run

    picked = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_num").cast("long").alias("page_num"), F.col("emb").cast("array<double>").alias("emb")).where("emb is not null")
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("emb").cast("array<double>").alias("emb")).where("emb is not null")
    return _ranked(picked, _query_blocks(asked, lambda r: 8 * len(r["emb"])), scorer, k)


def dense_scores(pairs: DataFrame, left: str = "q_emb", right: str = "emb") -> DataFrame:
    """D3 for given (query, page) pairs: adds ``score``."""
    return pairs.withColumn("score", dot(left, right))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, length): documents that have each term; the null term has the number and total length of all documents.

    One pass over the tokens gives both, and partial sums leave one row per term and task.
    """
    terms = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("length")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("terms").alias("length")))
    return docs.select(F.explode(F.concat(terms, whole)).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("x.length").alias("length"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Okapi BM25 of ``queries`` (qid, text) over ``docs`` (doc_id long, page_num long, text), best k.

    Query terms count as often as they occur; a query without known terms gets the first pages; negative idf becomes EPSILON times the mean idf of all terms.  A page's score is summed over
    the terms that it has and the queries that have these, so the work is that of the postings met, not of pages times terms.
    """
    tokenized = docs.select("doc_id", "page_num", tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    every = term_stats(tokenized).persist(StorageLevel.MEMORY_AND_DISK)
    size, stats = every.where("term is null").first(), every.where("term is not null")
    n, mean_length = (size["df"], size["length"] / size["df"] or 1.0) if size else (0, 1.0)
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = stats.agg(F.avg(idf).alias("m")).first()["m"] or 0.0

    def scorer(rows: list):
        names = sorted({t for r in rows for t in r["terms"]})
        wanted = queries.sparkSession.createDataFrame([(t,) for t in names], "term string")
        found = {r["term"]: r["idf"] for r in stats.join(wanted, "term", "left_semi").select("term", idf.alias("idf")).collect()}
        # postings of the block: for each term the queries that have it, with idf times occurrences
        held: dict[str, dict[int, float]] = {}
        for j, r in enumerate(rows):
            for t in r["terms"]:
                if t in found:
                    own = held.setdefault(t, {})
                    own[j] = own.get(j, 0.0) + (found[t] if found[t] >= 0 else EPSILON * mean_idf)
        names = sorted(held)
        count = np.array([len(held[t]) for t in names], np.int64)
        first = np.cumsum(count) - count
        asking = np.array([j for t in names for j in held[t]], np.int64)
        weight = np.array([w for t in names for w in held[t].values()])
        ids = np.array([r["qid"] for r in rows], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, best, n_q = pa.array(names, pa.string()), Best(len(ids), k), len(ids)
            rows_at_once = max(1, min(ROWS, CELLS // n_q))
            for batch in batches:
                for low in range(0, batch.num_rows, rows_at_once):
                    part = _in_order(batch.slice(low, rows_at_once))
                    terms, m = part.column(2), part.num_rows
                    length = np.asarray(terms.value_lengths().fill_null(0)).astype(np.int64)
                    at = pa.compute.index_in(terms.flatten(), value_set=vocabulary)
                    known = np.asarray(at.is_valid())
                    cell, tf = np.unique(np.repeat(np.arange(m), length)[known] * len(names) + np.asarray(at.fill_null(0))[known].astype(np.int64), return_counts=True)
                    row, term = cell // max(1, len(names)), cell % max(1, len(names))
                    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean_length))
                    score = np.zeros(m * n_q)
                    # as many (row, term) cells at once as have CELLS postings
                    edge = np.cumsum(count[term])
                    a = 0
                    while a < len(cell):
                        b = max(a + 1, int(np.searchsorted(edge, (edge[a - 1] if a else 0) + CELLS, "right")))
                        times = count[term[a:b]]
                        ends = np.cumsum(times)
                        posting = np.arange(ends[-1]) + np.repeat(first[term[a:b]] - (ends - times), times)
                        score += np.bincount(np.repeat(row[a:b], times) * n_q + asking[posting], np.repeat(value[a:b], times) * weight[posting], m * n_q)
                        a = b
                    best.add(0, score.reshape(m, n_q), np.asarray(part.column(0)), np.asarray(part.column(1)))
            yield best.rows(ids)

        return run

    asked = queries.select(F.col("qid").cast("long").alias("qid"), tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    out = _ranked(tokenized.select(F.col("doc_id").cast("long"), F.col("page_num").cast("long"), "terms"), _query_blocks(asked, lambda r: 64 * len(r["terms"]) + 64), scorer, k)
    every.unpersist()
    return out


def rrf(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rankings; ties by first appearance: list by list, in rank order."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("qid", "doc_id", "page_num", (F.lit(w) / (k + F.col("rank"))).alias("part"), (F.lit(i * 10**9) + F.col("rank")).cast("long").alias("seen")) for i, (x, w) in enumerate(zip(lists, weights))]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    fused = every.groupBy("qid", "doc_id", "page_num").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def hybrid(dense: DataFrame, sparse: DataFrame | None, top: int, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), fail_on_fallback: bool = False) -> DataFrame:
    """Dense and sparse fused and cut; dense alone where there is no sparse ranking (or an error, if so agreed)."""
    if sparse is None:
        if fail_on_fallback:
            raise RuntimeError("sparse backend is required")
        return dense.where(F.col("rank") <= top)
    return rrf([dense, sparse], k, list(weights)).where(F.col("rank") <= top)


def neighbor_bleed(pages: DataFrame, n: int = 200, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """Each page with the end of the page before and the start of the one after."""
    from pagemill.functions.text import strip

    order = Window.partitionBy(doc).orderBy(page)
    zero = F.lit("")
    before = F.right(F.coalesce(F.lag(text).over(order), zero), F.lit(n)) if n else zero
    after = F.left(F.coalesce(F.lead(text).over(order), zero), F.lit(n)) if n else zero
    return pages.withColumn("bled", strip(F.concat(before, F.col(text), after)))


def doc_pages(pages: DataFrame) -> DataFrame:
    """Sorted pages of each document."""
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("page_num")).alias("pages"), F.count(F.lit(1)).alias("n_pages"))


def segment_rows(pages: DataFrame, window: int, stride: int, demanded: DataFrame | None = None, short_doc_pages: int | None = None) -> DataFrame:
    """One row per segment; in lazy use only of demanded documents with more than ``short_doc_pages`` pages."""
    from pagemill.functions.text import segments

    if demanded is not None:
        pages = pages.join(demanded.select("doc_id").distinct(), "doc_id", "left_semi")
    if short_doc_pages is not None:
        long_docs = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > short_doc_pages).select("doc_id")
        pages = pages.join(long_docs, "doc_id", "left_semi")
    return pages.select("doc_id", "page_num", F.posexplode(segments("text", window, stride)).alias("seg_no", "x")).select("doc_id", "page_num", "seg_no", "x.start", "x.segment")


def wanted_docs(seed: DataFrame, docs: int = 3, doc_meta: DataFrame | None = None, min_top_doc_pages: int | None = None) -> DataFrame:
    """(qid, doc_id): the documents whose chunks a query asks for; none where its top document has too few pages."""
    from pagemill.operators.rank import doc_ranking

    ranked = doc_ranking(seed)
    wanted = ranked.where(F.col("rank") <= docs).select("qid", "doc_id")
    if min_top_doc_pages is not None:
        enough = doc_meta.where(F.col("n_pages") >= min_top_doc_pages).select("doc_id")
        open_q = ranked.where("rank = 1").join(enough, "doc_id", "left_semi").select("qid")
        wanted = wanted.join(open_q, "qid", "left_semi")
    return wanted


class BestPages(Best):
    """As ``Best``, for rows that are parts of pages: a page counts once, by its best part."""

    def cut(self) -> tuple[np.ndarray, ...]:
        if self.parts:
            q, score, doc, page = (np.concatenate(x) for x in zip(*self.parts))
            order = np.lexsort((score, page, doc, q))
            q, score, doc, page = q[order], score[order], doc[order], page[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])
            self.parts = [(q[new], score[new], doc[new], page[new])]
        return super().cut()


def chunk_scores(chunks: DataFrame, asked: DataFrame, pages_per_doc: int) -> DataFrame:
    """(qid, doc_id, page_num, score): the best ``pages_per_doc`` pages, by their best chunk, of each (qid, doc_id, emb) of ``asked``.

    Pairs come in blocks and meet all chunks in place: a task holds ``pages_per_doc`` rows a pair, whatever the number of a document's chunks.
    """

    def scorer(rows: list):
        rows = sorted(rows, key=lambda r: r["doc_id"])
        ids, docs = np.array([r["qid"] for r in rows], np.int64), np.array([r["doc_id"] for r in rows], np.int64)
        matrix = np.array([r["emb"] for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = BestPages(len(ids), pages_per_doc)
            for batch in batches:
                batch = batch.filter(pa.array(np.isin(np.asarray(batch.column(0)), docs)))
                for low in range(0, batch.num_rows, ROWS):
                    part = _in_order(batch.slice(low, ROWS))
                    doc, page = np.asarray(part.column(0)), np.asarray(part.column(1))
                    emb = np.asarray(part.column(2).flatten(), np.float64).reshape(part.num_rows, -1)
                    edge = [*np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)).tolist(), len(doc)]
                    for a, b in zip(edge, edge[1:]):
                        start = np.flatnonzero(np.diff(page[a:b], prepend=page[a] - 1))
                        first, last = np.searchsorted(docs, doc[a], "left"), np.searchsorted(docs, doc[a], "right")
                        for q in range(first, last, COLUMNS):
                            score = np.maximum.reduceat(emb[a:b] @ matrix[q : min(q + COLUMNS, last)].T, start, axis=0)
                            best.add(q, score, doc[a:b][start], page[a:b][start])
            yield best.rows(ids)

        return run

    picked = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_num").cast("long").alias("page_num"), F.col("emb").cast("array<double>").alias("emb")).where("emb is not null and doc_id is not null")
    pairs = asked.select(F.col("qid").cast("long").alias("qid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("emb").cast("array<double>").alias("emb")).where("emb is not null and doc_id is not null")
    return _joined(picked, _query_blocks(pairs, lambda r: 8 * len(r["emb"])), scorer)


def chunk_retrieval(seed: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, docs: int = 3, pages_per_doc: int = 6, doc_meta: DataFrame | None = None, min_top_doc_pages: int | None = None) -> DataFrame:
    """Pages of the first ``docs`` seed documents scored by their best chunk, merged with the seeds by maximum.

    ``chunks``: (doc_id, page_num, emb); ``queries``: (qid, emb); ``seed``: a ranking.
    """
    seed = written(seed.select("qid", "doc_id", "page_num", "score", "rank"), scratch_path(seed.sparkSession))  # it says what is wanted, and is merged
    wanted = wanted_docs(seed, docs, doc_meta, min_top_doc_pages)
    best = chunk_scores(chunks, wanted.join(queries.select("qid", "emb"), "qid"), pages_per_doc).groupBy("qid", "doc_id", "page_num").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid", "doc_id").orderBy(F.round("score", 9).desc(), "page_num")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pages_per_doc).drop("n")
    merged = seed.select("qid", "doc_id", "page_num", "score").unionByName(best.select("qid", "doc_id", "page_num", "score")).groupBy("qid", "doc_id", "page_num").agg(F.max("score").alias("score"))
    return top_k(merged, k)
