"""Operator 11: hard negatives by a full score sort for each anchor.

Vectors become integers (floor(256 * x)), so scores are exact integer inner products and nothing depends on the order of a sum.
For an anchor the scores of all rows are sorted by (score descending, id ascending); its positives are the first rows of its own label; for each
positive, the upper limit is found by binary search in the sorted scores of the rows with other labels, and the rows from there on that
reach the lower limit are its negatives.

Distribution.  Rows are packed into blocks by a hash of their id (a row of a written table each), anchors into smaller ones.  Each block of
rows meets a stream of all blocks of anchors: a task holds one block of rows, one of anchors and a strip of their scores.  A block's
sorted list gives its best rows for each anchor (positives) or positive (negatives); merging the lists of all blocks takes few rows a
block.  The anchors are a stated query set (every ``anchor_every``-th id) against all rows.  Positives must be
known before limits can be, so there are two passes over the scores.

Sums are exact: in single precision below 2**24 by Cauchy-Schwarz, in double precision below 2**53, else in 64-bit integers, which wrap.

Defined results: rows with a null id, label, vector or component, or a component that is not finite, take no part; rows equal in id, label and
vector count once; rows that share only the id are rows of their own, ties among them by label and a hash; shorter vectors count as
filled up with zeros; components beyond 64 bits stop at the bounds; an anchor without positives, or a positive without negatives, has no row; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_rows, bound_batches, saved

#: Most rows of a block, and the fewest that make a block worth while.
BLOCK_ROWS, LEAST_ROWS = 131_072, 1024
ANCHOR_ROWS = 1024
#: Cells of a strip of scores.
STRIP = 1 << 21
_POSITIVES = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("key", pa.int64())])
_POSITIVES_DDL = "anchor_id long, anchor_key long, score long, vec_id long, label long, key long"
_NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("positive_id", pa.int64()), ("positive_key", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("key", pa.int64())])
_NEGATIVES_DDL = "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long, negative_score long, vec_id long, label long, key long"


def integer_rows(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", moved_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, vec array<long>, key): the rows that take part, each once; ids divisible by ``moved_every`` move to the next label."""
    vec = F.col(embedding).cast("array<double>")
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), vec.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    moved = F.when(F.col("vec_id") % moved_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    own = own.select("vec_id", moved.alias("label"), F.transform("x", lambda x: F.floor(256 * x).cast("long")).alias("vec"))
    return own.withColumn("key", F.xxhash64("vec_id", "label", "vec"))


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, payload): the rows of each block by id as one Arrow stream; equal rows once. Blocks go by a hash of the id."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, keys = table["vec_id"].to_numpy(), table["key"].to_numpy()
            new = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.filter(pa.array(new)))
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            block = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and block[a] != last:
                    yield close()
                    held = []
                last = int(block[a])
                held.append(pa.RecordBatch.from_arrays(batch.columns[1:], names=names).slice(a, b - a))
        if held:
            yield close()

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), *names)
    return dealt.repartition("block").sortWithinPartitions("block", "vec_id", "label", "key").mapInArrow(run, "block int, payload binary")


class Block:
    def __init__(self, payload: bytes):
        self.table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.ids, self.labels, self.keys = (self.table[c].to_numpy() for c in ("vec_id", "label", "key"))
        lists = self.table["vec"].combine_chunks() if self.table["vec"].num_chunks != 1 else self.table["vec"].chunk(0)
        sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
        self.vecs = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
        self.vecs[np.arange(self.vecs.shape[1])[None, :] < sizes[:, None]] = flat
        self.norm = float(np.sqrt((self.vecs.astype(np.float64) ** 2).sum(1).max(initial=0)))
        self._as = {}

    def typed(self, kind: type, width: int) -> np.ndarray:
        if (kind, width) not in self._as:
            x = np.zeros((len(self.ids), width), kind)
            x[:, : self.vecs.shape[1]] = self.vecs
            self._as = {(kind, width): x}
        return self._as[kind, width]


def scores(anchors: Block, rows: Block) -> Iterator[tuple[int, np.ndarray]]:
    """Strips of integer scores: (first anchor, scores[anchor, row])."""
    most, width = anchors.norm * rows.norm, max(anchors.vecs.shape[1], rows.vecs.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    a, b = anchors.typed(kind, width), rows.typed(kind, width)
    step = max(1, STRIP // max(1, len(rows.ids)))
    for i in range(0, len(a), step):
        yield i, (a[i : i + step] @ b.T).astype(np.int64)


def meet(pairs: DataFrame, each, ddl: str) -> DataFrame:
    """``each(anchors, rows)`` for every block of rows and every block of anchors, the latter as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            for turn, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
                block = Block(payload.as_py())
                if turn == 0:
                    rows = block
                else:
                    yield from each(block, rows)

    return pairs.mapInArrow(run, ddl)


def _pairs(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """(block, turn, payload): each block of rows (turn 0), then all blocks of anchors."""
    every = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.col("block") + 1).alias("turn"), "payload")
    both = rows.select("block", F.lit(0).alias("turn"), "payload").unionByName(every.join(rows.select("block"), "block", "left_semi"))
    return both.repartitionByRange(blocks, "block").sortWithinPartitions("block", "turn")


def best_of_label(most: int):
    """Positives: the first ``most`` other rows of the anchor's label, in a block."""

    def each(anchors: Block, rows: Block) -> Iterator[pa.RecordBatch]:
        who, which, score = [], [], []
        for first, strip in scores(anchors, rows):
            order = np.argsort(-strip, axis=1, kind="stable")  # a block is in the order of ids: sorted by score, then id
            for i, own in enumerate(order):
                a = first + i
                fits = own[rows.labels[own] == anchors.labels[a]][: most + 1]
                fits = fits[(rows.ids[fits] != anchors.ids[a]) | (rows.keys[fits] != anchors.keys[a])][:most]
                who.append(np.full(len(fits), a))
                which.append(fits)
                score.append(strip[i, fits])
        who, which = np.concatenate(who), np.concatenate(which)
        yield arrow_rows(_POSITIVES, anchor_id=anchors.ids[who], anchor_key=anchors.keys[who], score=np.concatenate(score), vec_id=rows.ids[which], label=rows.labels[which], key=rows.keys[which])

    return each


def below_limits(most: int, low: int, high: int):
    """Negatives: for each positive, the first ``most`` rows of other labels with low * positive <= 100 * score <= high * positive, in a block."""

    def each(anchors: Block, rows: Block) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {f.name: [] for f in _NEGATIVES}
        positives = [anchors.table[c].to_pylist() for c in ("positive_ids", "positive_keys", "positive_scores")]
        for first, strip in scores(anchors, rows):
            order = np.argsort(-strip, axis=1, kind="stable")
            for i, own in enumerate(order):
                a = first + i
                other = own[rows.labels[own] != anchors.labels[a]]
                falling = -strip[i, other]
                for p_id, p_key, p in zip(*(x[a] for x in positives)):
                    start = int(np.searchsorted(falling, -min(high * p // 100, 2**63 - 1), "left"))
                    for at in other[start : start + most].tolist():
                        s = int(strip[i, at])
                        if 100 * s < low * p:
                            break
                        for name, x in zip(found, (int(anchors.ids[a]), int(anchors.keys[a]), p_id, p_key, p, s, int(rows.ids[at]), int(rows.labels[at]), int(rows.keys[at]))):
                            found[name].append(x)
        yield arrow_rows(_NEGATIVES, **found)

    return each


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, moved_every: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's docstring."""
    bound_batches(rows.sparkSession)
    own = integer_rows(rows, vec_id, embedding, label, moved_every, labels)
    is_anchor = F.col("vec_id") % anchor_every == 0
    n, n_anchors = own.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    blocks = max(1, min(64, n // LEAST_ROWS), -(-n // BLOCK_ROWS))
    groups = max(1, -(-n_anchors // ANCHOR_ROWS))
    row_blocks = saved(packed(own, blocks))
    anchors = own.where(is_anchor)
    near = meet(_pairs(row_blocks, packed(anchors, groups), blocks), best_of_label(positives), _POSITIVES_DDL)
    first = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "vec_id", "label", "key")
    kept = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    lists = kept.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "key", "score"))).alias("p"))  # bounded: ``positives``
    lists = lists.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), F.col("p.vec_id").alias("positive_ids"), F.col("p.key").alias("positive_keys"), F.col("p.score").alias("positive_scores"))
    limited = anchors.join(lists, ["vec_id", "key"]).select("vec_id", "label", "vec", "key", "positive_ids", "positive_keys", "positive_scores")
    far = meet(_pairs(row_blocks, packed(limited, groups), blocks), below_limits(negatives, low, high), _NEGATIVES_DDL)
    again = Window.partitionBy("anchor_id", "anchor_key", "positive_id", "positive_key").orderBy(F.desc("negative_score"), "vec_id", "label", "key")
    ranked = far.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", "negative_score")
