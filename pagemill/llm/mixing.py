"""Operator 4: mixing sources to target weights with the cube method.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share
150 % of all words; no target exceeds twice its source's words, what is over is
shared again by weight.  That is a water level L with target = min(2 * size, L * weight),
found in closed form from running sums over the table of sources.

Every document is taken floor(rate) times; the fractional part of the rate is its
inclusion probability.  The cube method (Deville and Tille) moves the vector of
probabilities through the null space of the balancing constraints (documents and
words taken), a martingale that ends each step with one more probability at 0 or
1.  Each step touches three units, so a pass is linear.  A source's documents are cut into
blocks of about ``BLOCK``; two units of a block at most stay
fractional and go to the next level, so a hot source is split like any other and only a
landing problem of a few units per source is left; it is solved by enumeration.

Defined results: null text: size 0, taken 0; null source: a source, last;
repeated rows: drawn one by one; empty table: empty result; null doc_id: a row.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import saved, unused_prefix

#: Weights of the sources in turn, share of all words, most copies of a source.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 2048
LEVELS = 3
_NEAR = 1e-9
_NO_ID = -(2**63)


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_no, n_docs, source_size, target): one row per source; windows run over sources, not documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = by.withColumn("source_no", number).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", F.col("source_size") * MOST)
    # fill the sources in the order in which they reach their caps
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = weighed.withColumn("level", (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = level.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("level"))))
    found = F.min("open").over(every)["level"]
    return first.select("source", "source_no", "n_docs", "source_size", F.least(F.col("cap"), F.coalesce(found, F.lit(0.0)) * F.col("weight")).alias("target"))


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1; sums of pi and pi * x are kept."""
    pi = pi.astype(float).tolist()
    size = x.astype(float).tolist()
    draws = iter(rng.random(len(pi) + 3).tolist())
    active: list[int] = []
    for i in range(len(pi)):
        if not _NEAR < pi[i] < 1 - _NEAR:
            pi[i] = round(pi[i])
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - pi[k]) / d if d > 0 else pi[k] / -d) for k, d in zip(active, u) if d)
        down = min((pi[k] / d if d > 0 else (1 - pi[k]) / -d) for k, d in zip(active, u) if d)
        move = up if next(draws) * (up + down) < down else -down
        for k, d in zip(active, u):
            pi[k] += move * d
            if not _NEAR < pi[k] < 1 - _NEAR:
                pi[k] = float(round(pi[k]))
        active = [k for k in active if 0 < pi[k] < 1]
    return np.array(pi)


def landing(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The 0/1 vector nearest in words, then in documents, for the few units that are left."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    out = pi.copy()
    if not len(open_):
        return out
    if len(open_) > 12:  # cannot be after a flight, which leaves two; kept so that any input ends
        out[open_] = np.round(pi[open_])
        return out
    p, s = pi[open_], x[open_]
    out[open_] = min(product((0.0, 1.0), repeat=len(open_)), key=lambda v: (round(abs(float(((np.array(v) - p) * s).sum())), 6), round(abs(float((np.array(v) - p).sum())), 6), v))
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", key=None) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, copies (and ``key``, if given)."""
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), (F.xxhash64(F.col(doc_id).cast("long")) if key is None else key).alias("key"))
    sized = saved(sized)
    goal = saved(targets(sized))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sized.join(goal, sized.source.eqNullSafe(goal.source)).select(sized.doc_id, sized.source, "size", "key", "source_no", "source_size", "target", "n_docs", rate.alias("rate"))
    base = F.floor(F.col("rate") + _NEAR)
    units = rated.select("*", base.cast("long").alias("base"), F.when(F.col("size") > 0, F.greatest(F.col("rate") - base, F.lit(0.0))).otherwise(0.0).alias("pi"))
    units = units.withColumn("block", F.pmod(F.xxhash64("key", "doc_id", "size"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK))))

    def fly(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "doc_id", "size"], kind="stable", ignore_index=True)
            rng = np.random.default_rng([level, int(pdf.source_no[0]), int(pdf.block[0])])
            order = rng.permutation(len(pdf))
            pi = np.empty(len(pdf))
            pi[order] = flight(pdf.pi.to_numpy()[order], pdf["size"].to_numpy()[order], rng)
            if level == LEVELS - 1:
                pi = landing(pi, pdf["size"].to_numpy())
            pdf["pi"] = pi
            return pdf

        return run

    # pandas has no integer null: a stand-in for the flight only
    units = units.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    done = []
    for level in range(LEVELS):
        at = F.lit(0).cast("long") if level == LEVELS - 1 else F.floor(F.col("block") / (BLOCK // 2) ** level).cast("long")
        units = units.withColumn("block", at) if level else units
        flown = saved(units.groupBy("source_no", "block").applyInPandas(fly(level), units.schema))
        done.append(flown.where("pi = 0 or pi = 1"))
        units = flown.where("pi > 0 and pi < 1")
    every = done[0].unionByName(done[1]).unionByName(done[2])
    copies = F.col("base") + F.col("pi").cast("long")
    return every.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "size", "source", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns that it came with."""
    own = unused_prefix(docs)
    key, n, take, m, copies, i = (f"{own}{x}" for x in ("k", "n", "j", "m", "c", "i"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"), F.col("source")))
    taken = mix(keyed, key=F.col(key)).where("copies > 0").select(F.col("key").alias(take), F.col("copies").alias(copies))
    taken = taken.withColumn(m, F.row_number().over(Window.partitionBy(take).orderBy(copies)))
    numbered = keyed.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy("doc_id")))
    return numbered.join(taken, (F.col(key) == F.col(take)) & (F.col(n) == F.col(m))).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
