"""An inverted index for BM25 (D11) with upper bounds, and a search that leaves out what cannot reach the best k.

Index: pages are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash of their id.  A block is a row of its pages (ids and lengths, in the
order of document and page) and a row for each of its terms: the pages that have it, how often, and ``most``, the largest weight that it
gives to a page of the block.  Beside it: ``terms`` (document frequency and idf over all blocks).  All three are written tables; a search reads the rows of
its own terms only.

Search: queries, packed in groups, are a stated set against all blocks.  In a block the terms of a query are taken in the order of their upper bounds
(query weight times ``most``).  Once the k-th best page so far beats the sum of the bounds that are left, no page that has not been met can
enter: the rest of the lists is looked up for the pages that still can, and not read through.  Scores and order are those of ``retrieve.bm25_topk``:
pages without a term count 0 and fill up by document and page.  A task holds the wanted lists of one block; it sends on k pages a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import tokens
from pagemill.operators.retrieve import EPSILON, K1, B, top_k
from pagemill.sources.scratch import written

BLOCK_BYTES = 8 << 20
QUERIES_AT_ONCE = 500
_BLOCKS = pa.schema([("block", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("most", pa.float64()), ("pages", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
_BLOCKS_DDL = "block int, term string, df long, most double, pages binary, counts binary, docs binary"
_FOUND = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("page_num", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "qid long, doc_id long, page_num long, score double"


@dataclass
class Index:
    blocks: DataFrame
    terms: DataFrame
    n_blocks: int
    mean_length: float
    mean_idf: float


def impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def build_index(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> Index:
    """Writes the index of ``docs`` (doc_id long, page_num long, text) under ``path``."""
    text = F.coalesce("text", F.lit(""))
    tokenized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_num").cast("long").alias("page_num"), tokens(text).alias("terms"), F.octet_length(text).alias("bytes"))
    n, length, size = tokenized.agg(F.count(F.lit(1)), F.sum(F.size("terms")), F.sum("bytes")).first()
    n_blocks, mean = max(1, -(-(size or 0) // block_bytes)), (length or 0) / max(1, n) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None

        def close() -> Iterator[pa.RecordBatch]:
            doc, page = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (1, 2))
            lists = pa.chunked_array([b.column(3) for b in held]).combine_chunks()
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            names, at = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
            cell, tf = np.unique(at * len(doc) + np.repeat(np.arange(len(doc)), sizes), return_counts=True)
            term, own = cell // max(1, len(doc)), (cell % max(1, len(doc))).astype(np.int32)
            weight = impact(tf, sizes[own], mean)
            cuts = np.searchsorted(term, np.arange(len(names) + 1))
            most = np.maximum.reduceat(weight, cuts[:-1]) if len(names) else weight
            counts, about = tf.astype(np.int32), np.concatenate([doc, page, sizes])
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.nulls(1, pa.string()), pa.array([len(doc)], pa.int64()), pa.nulls(1, pa.float64()), none, none, pa.array([about.tobytes()], pa.binary())], schema=_BLOCKS)
            for a in range(0, len(names), 4096):
                b = min(len(names), a + 4096)
                parts = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in range(a, b)], pa.binary()) for x in (own, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block, np.int32)), names.slice(a, b - a), pa.array(np.diff(cuts[a : b + 1])), pa.array(most[a:b]), *parts, pa.nulls(b - a, pa.binary())], schema=_BLOCKS)

        for batch in batches:
            blocks = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and blocks[a] != block:
                    yield from close()
                    held = []
                block = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    dealt = tokenized.select(F.pmod(F.xxhash64("doc_id", "page_num"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "page_num", "terms")
    blocks = written(dealt.repartition("block").sortWithinPartitions("block", "doc_id", "page_num").mapInArrow(run, _BLOCKS_DDL), f"{path}/blocks")
    df = blocks.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    terms = written(df.select("term", "df", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), f"{path}/terms")
    return Index(blocks, terms, n_blocks, mean, terms.agg(F.avg("idf")).first()[0] or 0.0)


class Block:
    """The pages of a block and the wanted lists; counts what a search has read of them."""

    def __init__(self, about: bytes, mean: float):
        self.doc, self.page, self.length = np.frombuffer(about, np.int64).reshape(3, -1)
        self.mean, self.lists, self.read, self.there = mean, {}, 0, 0

    def add(self, term: str, most: float, pages: bytes, counts: bytes) -> None:
        self.lists[term] = (most, np.frombuffer(pages, np.int32), np.frombuffer(counts, np.int32))

    def best(self, weights: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(pages, scores) of the best k."""
        # terms of no or negative weight bound nothing: they are read through first
        mine = sorted(((w, *self.lists[t]) for t, w in weights if t in self.lists), key=lambda x: (x[0] > 0, -x[0] * x[1]))
        left = np.append(np.cumsum([max(0.0, w) * most for w, most, *_ in mine][::-1])[::-1], 0.0)
        score = np.zeros(len(self.doc))
        self.there += sum(len(pages) for _, _, pages, _ in mine)
        for j, (w, _, pages, counts) in enumerate(mine):
            if w > 0 and j and len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                if least - 2e-9 > left[j]:
                    return self._looked_up(mine[j:], left[j:], score, k)
            self.read += len(pages)
            score[pages] += w * impact(counts, self.length[pages], self.mean)
        return self._first(np.arange(len(score)), score, k)

    def _looked_up(self, rest: list, left: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(score, len(score) - k)[len(score) - k]
        able = np.flatnonzero(score + left[0] >= least - 2e-9)
        own = score[able]
        for j, (w, _, pages, counts) in enumerate(rest):
            at = np.minimum(np.searchsorted(pages, able), len(pages) - 1)
            hit = np.flatnonzero(pages[at] == able)
            self.read += len(hit)
            own[hit] += w * impact(counts[at[hit]], self.length[able[hit]], self.mean)
            least = np.partition(own, len(own) - k)[len(own) - k]
            stay = own + left[j + 1] >= least - 2e-9
            able, own = able[stay], own[stay]
        return self._first(able, own, k)

    def _first(self, pages: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pages are in the order of document and page, by which equal scores go."""
        rounded = np.round(score, 9)
        if len(rounded) > k:
            least = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
            above, level = np.flatnonzero(rounded > least), np.flatnonzero(rounded == least)
            keep = np.concatenate([above, level[: k - len(above)]])
        else:
            keep = np.arange(len(rounded))
        return pages[keep], rounded[keep]


def _met(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, page_num, score), and for each block a row with a null qid: postings read and postings there."""
    asked = queries.select(F.col("qid").cast("long").alias("qid"), tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    counted = asked.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.when(F.col("idf") >= 0, F.col("idf")).otherwise(EPSILON * index.mean_idf)
    weighted = counted.join(index.terms, "term").select("qid", F.struct("term", (F.col("n") * idf).alias("weight")).alias("t"))
    whole = asked.select("qid").join(weighted.groupBy("qid").agg(F.collect_list("t").alias("terms")), "qid", "left")  # a query's own terms
    n_groups = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    packed = whole.groupBy(F.pmod(F.xxhash64("qid"), F.lit(n_groups)).alias("g")).agg(F.collect_list(F.struct("qid", F.coalesce("terms", F.array().cast("array<struct<term:string,weight:double>>")).alias("terms"))).alias("queries"))
    there = index.blocks.where("term is null").select("block", F.lit(0).alias("turn"), "term", "most", "pages", "counts", "docs")
    lists = index.blocks.join(counted.select("term").distinct(), "term", "left_semi").select("block", F.lit(1).alias("turn"), "term", "most", "pages", "counts", "docs")
    asks = packed.select(F.explode(F.sequence(F.lit(0), F.lit(index.n_blocks - 1))).alias("block"), F.lit(2).alias("turn"), "queries")
    rows = there.unionByName(lists).unionByName(asks, allowMissingColumns=True).select("block", "turn", "term", "most", "pages", "counts", "docs", "queries")
    mean = index.mean_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([block.read]), pa.array([block.there]), pa.nulls(1, pa.float64())], schema=_FOUND)

        for batch in batches:
            for at, turn, term, most, pages, counts, docs, asks in zip(*(batch.column(i) for i in range(8))):
                if turn.as_py() == 0:
                    if block is not None:
                        yield told()
                    block, number = Block(docs.as_py(), mean), at.as_py()
                elif at.as_py() != number:
                    continue  # a block without pages
                elif turn.as_py() == 1:
                    block.add(term.as_py(), most.as_py(), pages.as_py(), counts.as_py())
                else:
                    for q in asks.as_py():
                        found, score = block.best([(t["term"], t["weight"]) for t in q["terms"]], k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q["qid"])), pa.array(block.doc[found]), pa.array(block.page[found]), pa.array(score)], schema=_FOUND)
        if block is not None:
            yield told()

    return rows.repartition("block").sortWithinPartitions("block", "turn", "term").mapInArrow(run, _FOUND_DDL)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, page_num, score, rank): the best k pages of each query (qid, text)."""
    return top_k(_met(index, queries, k).where("qid is not null"), k)


def postings_read(index: Index, queries: DataFrame, k: int) -> tuple[int, int]:
    """How many postings of the wanted lists a search reads, and how many there are."""
    row = _met(index, queries, k).where("qid is null").agg(F.sum("doc_id").alias("read"), F.sum("page_num").alias("there")).first()
    return row["read"] or 0, row["there"] or 0
