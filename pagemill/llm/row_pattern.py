"""Operator 12: row pattern matching by a right-to-left dynamic programme and a forward walk.

The pattern ``A (D|U)* P D*`` over the rows of one key in time order, with the meaning that a
backtracking matcher gives it (greedy, D before U, first match from each start).

Automaton states after A: 1, inside ``(D|U)*``; 2, after P, inside ``D*``.  For a row i and a state the programme stores the
largest A-cents with which the rest of the pattern can still succeed from row i on:

* ``best[1][i] = max(cents[i] if i can be P, best[1][i + 1] if i is D or U)``, minus infinity if neither holds;
* ``best[2][i]`` is plus infinity, as ``D*`` may stop anywhere.

It is filled from right to left (segmented doubling).  A start s succeeds exactly if ``cents[s] <= best[1][s + 1]``.  The walk goes forward and
takes D or U as long as the next row's ``best`` still allows the A-cents, then P, then every D: it never steps back.

Distribution.  No key is gathered: rows are dealt by ranges of (key, time, id), so a key with a third of all rows spans
as many tasks as its rows need.  A row that can be none of D, U and P is a *break*: no match reaches over it, so the search
begins anew there, whatever came before.  A task settles all stretches between its breaks; the rows before its first and after its last
break are the pieces of *chains* over task borders.  Chains are short (a piece is a stretch without a break), are dealt by
chain and settled in a second step.  Numbers of matches come from counts by (key, slot), a slot being a task's chained head, its settled middle,
or its chained tail.  Tables between the steps are written, so lost executors repeat one step at most.  Memory: a batch, and the longest stretch without a break.

Defined results: rows with a null key or time take no part; rows equal in all columns count once; a null, NaN or infinite value fits no letter;
rows that tie in time and id are ordered by kind, value and a hash of the other columns (nulls first); a null id sorts first and comes back as
null; cents beyond 64 bits stop at the bounds; an empty table gives an empty result; columns of other names take no part but in
telling rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import bound_batches, saved

GAP = 15 * 60 * 1_000_000
_LEAST = np.iinfo(np.int64).min
_STEP = pa.schema([("what", pa.int8()), ("key", pa.int64()), ("slot", pa.int64()), ("nth", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels", pa.string()), ("ts", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("kind", pa.int8()), ("part", pa.int64()), ("seq", pa.int64()), ("inner", pa.bool_())])
_STEP_DDL = "what byte, key long, slot long, nth long, first_id long, last_id long, n_rows long, sum_cents long, labels string, ts long, id long, cents long, kind byte, part long, seq long, inner boolean"
MATCH, PIECE, TASK = 0, 1, 2
#: Kinds of rows: fits A only, also D or U, also P.
ONLY_A, MOVES, VIEW = 0, 1, 2


class Rows:
    """Columns of rows in order, as numpy arrays; ``has``/``id_null`` are the null masks of cents and id."""

    __slots__ = ("cents", "chain", "has", "id", "id_null", "key", "kind", "part", "seq", "ts")

    def __init__(self, **columns):
        for k in self.__slots__:
            setattr(self, k, columns[k])

    def __len__(self) -> int:
        return len(self.key)

    def cut(self, a: int, b: int | None = None) -> Rows:
        return Rows(**{k: getattr(self, k)[a:b] for k in self.__slots__})

    def with_more(self, other: Rows) -> Rows:
        return Rows(**{k: np.concatenate([getattr(self, k), getattr(other, k)]) for k in self.__slots__})


def letters(rows: Rows, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(down, up, can be P) of each row, as far as the row before it tells; the first row is none of them."""
    n = len(rows)
    down, up, peak = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        near = (rows.key[1:] == rows.key[:-1]) & (rows.chain[1:] == rows.chain[:-1]) & (rows.ts[1:] - rows.ts[:-1] <= gap) & rows.has[1:]
        moves = near & rows.has[:-1] & (rows.kind[1:] >= MOVES)
        down[1:] = moves & (rows.cents[1:] < rows.cents[:-1])
        up[1:] = moves & (rows.cents[1:] > rows.cents[:-1])
        peak[1:] = near & (rows.kind[1:] == VIEW)
    return down, up, peak


def best_of(cents: np.ndarray, moves: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """``best[1]`` of each row; the smallest 64-bit number stands for "cannot succeed"."""
    best = np.where(peak, cents, _LEAST)
    n = len(best)
    # a row that is neither D nor U ends the stretch that it is part of
    ends = np.cumsum(~moves[::-1])[::-1]
    step = 1
    while step < n:
        linked = ends[:-step] == ends[step:]  # all rows between move
        if not linked.any():
            break
        better = np.where(linked, np.maximum(best[:-step], best[step:]), best[:-step])
        best = np.concatenate([better, best[n - step :]])
        step *= 2
    return best


def walk(rows: Rows, gap: int = GAP) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, letters) of the matches in ``rows``, which must begin with a break and be followed by one."""
    n = len(rows)
    if n < 2:
        return
    down, up, peak = letters(rows, gap)
    moves = down | up
    best = best_of(rows.cents, moves, peak)
    able = np.flatnonzero(rows.has[:-1] & peak_or(moves, peak)[1:] & (best[1:] != _LEAST) & (rows.cents[:-1] <= best[1:])).tolist()
    if not able:
        return
    last_down = np.flatnonzero(~np.append(down[1:], False))  # rows whose next row is no D
    run_end = last_down[np.searchsorted(last_down, np.arange(n))].tolist()
    names = np.where(down, np.uint8(ord("D")), np.uint8(ord("U"))).tobytes()
    cents, best, moves = rows.cents.tolist(), [*best.tolist(), _LEAST], [*moves.tolist(), False]
    at = 0
    for s in able:
        if s < at:
            continue
        own, p = cents[s], s + 1
        while moves[p] and best[p + 1] != _LEAST and own <= best[p + 1]:
            p += 1
        e = run_end[p]
        yield s, e, b"A" + names[s + 1 : p] + b"P" + names[p + 1 : e + 1]
        at = e


def peak_or(moves: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """Rows that a match can reach over or end with: all others are breaks."""
    return moves | peak


def _filled(column) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for nulls, null mask) of an Arrow column of integers or times."""
    column = column if column.type == pa.int8() else column.cast(pa.int64())
    nulls = np.asarray(column.is_null())
    return np.asarray(column.fill_null(0)), nulls


def _out(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _STEP], schema=_STEP)


class _Found:
    """Matches on their way out, numbered within (key, slot)."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.last, self.nth = None, 0

    def add(self, rows: Rows, a: int, b: int, labels: bytes, slot: int) -> None:
        where = (int(rows.key[a]), slot)
        self.nth = self.nth + 1 if where == self.last else 1
        self.last = where
        ids = [None if rows.id_null[i] else int(rows.id[i]) for i in (a, b)]
        self.rows.append((*where, self.nth, *ids, b - a + 1, int(rows.cents[a : b + 1].sum()), labels.decode()))

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            key, slot, nth, first, last, n, cents, labels = zip(*self.rows)
            self.rows = []
            yield _out(what=np.full(len(key), MATCH, np.int8), key=key, slot=slot, nth=nth, first_id=first, last_id=last, n_rows=n, sum_cents=cents, labels=labels)


def _pieces(rows: Rows, inner: bool) -> Iterator[pa.RecordBatch]:
    if len(rows):
        yield _out(what=np.full(len(rows), PIECE, np.int8), key=rows.key, ts=rows.ts, id=pa.array(rows.id, mask=rows.id_null), cents=pa.array(rows.cents, mask=~rows.has), kind=rows.kind, part=rows.part, seq=rows.seq, inner=np.full(len(rows), inner))


def _settle(gap: int):
    """First step: a range of rows in order; matches between its breaks, and the pieces at its ends (``inner``: after a break)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), _Found()
        seq, before, held, broken = 0, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [_filled(batch.column(i)) for i in range(7)]
            same = np.ones(batch.num_rows, bool)  # as the row before it: the same row again
            for values, nulls in columns:
                same[1:] &= (values[1:] == values[:-1]) & (nulls[1:] == nulls[:-1])
            now = [(int(v[-1]), bool(m[-1])) for v, m in columns]
            same[0] = before == [(int(v[0]), bool(m[0])) for v, m in columns]
            before, new = now, ~same
            (key, _), (ts, _), (ids, id_null), (cents, none), (kind, _) = ((v[new], m[new]) for v, m in columns[:5])
            n = len(key)
            more = Rows(key=key, ts=ts, id=ids, id_null=id_null, cents=cents, has=~none, kind=kind, part=np.full(n, part), seq=np.arange(seq, seq + n), chain=np.zeros(n, np.int64))
            seq += n
            held = more if held is None else held.with_more(more)
            down, up, peak = letters(held, gap)
            breaks = np.flatnonzero(~peak_or(down | up, peak))  # the first row counts as one: what came before it is not known here
            if not broken:
                if len(held) and (not held.has[0] or held.kind[0] == ONLY_A) and held.seq[0] == 0:
                    start = 0  # a break whatever came before
                else:
                    later = breaks[breaks > 0]
                    if not len(later):
                        yield from _pieces(held.cut(0, -1), False)  # the last row stays: the next one's letters depend on it
                        held = held.cut(-1)
                        continue
                    start = int(later[0])
                yield from _pieces(held.cut(0, start), False)
                held, breaks, broken = held.cut(start), breaks[breaks >= start] - start, True
            if len(breaks) and breaks[-1] > 0:
                for a, b, labels in walk(held.cut(0, int(breaks[-1])), gap):
                    found.add(held, a, b, labels, 3 * part + 1)
                held = held.cut(int(breaks[-1]))
            yield from found.flush(4096)
        if held is not None:
            yield from _pieces(held, broken)
        yield from found.flush()
        yield _out(what=np.array([TASK], np.int8), part=[part], inner=[broken])

    return run


def _settle_chains(gap: int):
    """Second step: pieces sorted by (chain, task, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, inner = _Found(), None, np.zeros(0, bool)

        def settle(rows: Rows, tail: np.ndarray) -> None:
            for a, b, labels in walk(rows, gap):
                found.add(rows, a, b, labels, 3 * int(rows.part[a]) + (2 if tail[a] else 0))

        for batch in batches:
            if not batch.num_rows:
                continue
            (chain, _), (part, _), (seq, _), (key, _), (ts, _), (ids, id_null), (cents, none), (kind, _) = (_filled(batch.column(i)) for i in range(8))
            more = Rows(key=key, ts=ts, id=ids, id_null=id_null, cents=cents, has=~none, kind=kind, part=part, seq=seq, chain=chain)
            held, inner = more if held is None else held.with_more(more), np.concatenate([inner, np.asarray(batch.column(8))])
            down, up, peak = letters(held, gap)
            last = int(np.flatnonzero(~peak_or(down | up, peak))[-1])
            settle(held.cut(0, last), inner)
            held, inner = held.cut(last), inner[last:]
            yield from found.flush(4096)
        if held is not None:
            settle(held, inner)
        yield from found.flush()

    return run


def _chains(tasks: DataFrame) -> DataFrame:
    """(part, up): the nearest earlier task with a break, or -1; pointer doubling over tasks without one."""
    ups = saved(tasks.select("part", F.col("inner").alias("broken"), (F.col("part") - 1).alias("up")))
    while True:
        through = ups.where("not broken").select(F.col("part").alias("t"), F.col("up").alias("t_up"))
        step = ups.join(through, F.col("up") == F.col("t"), "left")
        if not step.where("t is not null").limit(1).count():
            return ups
        ups = saved(step.select("part", "broken", F.coalesce("t_up", "up").alias("up")))


def find_matches(rows: DataFrame, key: str = "client_id", ts: str = "ts", row_id: str = "click_id", kind: str = "kind", value: str = "value", gap: int = GAP) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, sum_cents, labels): the matches of each key, numbered from 1; see the module's docstring.

    ``gap``: microseconds that D, U and P may come after the row before them.  ``labels``: one matched letter a row.
    """
    bound_batches(rows.sparkSession)
    v = F.col(value).cast("double")
    rest = sorted(c for c in rows.columns if c not in (key, ts, row_id))
    text = {value: (v + 0.0).cast("string")}  # -0.0 is 0.0
    whole = [x for c in rest for x in (F.col(f"`{c}`").isNull(), text.get(c, F.col(f"`{c}`").cast("string")))]  # with null marks, as hashes leave nulls out
    fits = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    columns = [
        F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.col(row_id).cast("long").alias("id"), F.when(fits, F.floor(100 * v + 0.5)).cast("long").alias("cents"),
        F.when(F.col(kind) == "view", VIEW).when(F.col(kind) != "error", MOVES).otherwise(ONLY_A).cast("byte").alias("kind"), F.xxhash64(*whole).alias("d1"), F.hash(*whole).cast("long").alias("d2"),
        F.col(kind).cast("string").alias("kind_name"), v.alias("value"),
    ]
    own = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(*columns)
    ordered = own.repartitionByRange("key", "ts", "id").sortWithinPartitions("key", "ts", "id", "kind_name", "value", "d1", "d2")
    first = saved(ordered.select("key", "ts", "id", "cents", "kind", "d1", "d2").mapInArrow(_settle(gap), _STEP_DDL))
    ups = _chains(first.where(F.col("what") == TASK))
    pieces = first.where(F.col("what") == PIECE).join(ups, "part")
    chained = pieces.select(F.when(F.col("inner"), F.col("part")).otherwise(F.col("up")).alias("chain"), "part", "seq", "key", "ts", "id", "cents", "kind", "inner")
    second = saved(chained.repartition("chain").sortWithinPartitions("chain", "part", "seq").mapInArrow(_settle_chains(gap), _STEP_DDL))
    names = ["key", "slot", "nth", "first_id", "last_id", "n_rows", "sum_cents", "labels"]
    found = first.where(F.col("what") == MATCH).select(*names).unionByName(second.select(*names))
    counts = found.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("key", "slot", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    return found.join(offsets, ["key", "slot"]).select(F.col("key").alias(key), (F.col("earlier") + F.col("nth")).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")
