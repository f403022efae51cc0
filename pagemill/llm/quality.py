"""Operator 9: quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's measures are computed once, over its whole text.  For every
(lang, source) group each measure goes into a DDSketch-like histogram: bucket
ceil(log(x) / log(gamma)), merged by adding counts.  The merge is exact and does
not depend on order, so reruns agree, partial aggregation leaves at most
one row per bucket and task, and a group with a third of all rows costs no more
than a small one.  A sketch gives the quartiles within ``RELATIVE`` error; the cut
of a group is the Tukey fence q3 + FENCE * (q3 - q1) (and the lower fence for
word length), never tighter than the slack below it.  Groups with fewer than
``LEAST`` documents take the cuts of their language, and small languages those of
all documents. The cuts are joined back and filter the rows.

Defined results: null or wordless text: zero measures, base_failed (fewer than
20 words); null lang or source: a group of its own; repeated rows: each is a
row; empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Words, arrow_rows, blocks, gram_ids, mix, powers, saved, texts_of, unused_prefix

RELATIVE = 0.01
FENCE = 6.0
LEAST = 100
MIN_WORDS = 20
WINDOW = 8
#: Measures, and the least distance that a cut keeps from the quartile.
MEASURES = {"mean_word_chars": 1.5, "symbol_ratio": 0.05, "dup_line_ratio": 0.4, "repeat_ratio": 0.25, "punct_ratio": 0.1, "digit_ratio": 0.25, "echo_ratio": 0.15}
_GAMMA = (1 + RELATIVE) / (1 - RELATIVE)
_OFFSET = 1e-4
_SYMBOL, _DIGIT, _PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT[list(b"0123456789")] = True
_PUNCT[list(b"!\"'(),-./:;?@[\\]^_`{}~+=")] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_punct", "n_echo"]


def _repeats(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each (doc, id), whether it occurs twice or more."""
    key = mix(ids ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def measure_block(w: Words) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    n, buf = w.n_docs, w.data
    out = {"n_words": w.count.astype(np.int64)}

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[w.doc_start])

    space = np.ones(len(buf), bool)
    solid = np.zeros(len(buf) + 1, np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    space = np.cumsum(solid[:-1], dtype=np.int8) == 0
    out["word_chars"] = per_doc(~space & ((buf & 0xC0) != 0x80))
    out["n_symbols"], out["n_digits"], out["n_punct"] = per_doc(_SYMBOL[buf]), per_doc(_DIGIT[buf]), per_doc(_PUNCT[buf])

    # lines: pieces between \n; the space that ends a document ends its last line
    last = np.zeros(len(buf), bool)
    last[w.doc_start[1:] - 1] = True
    ends = np.flatnonzero((buf == 10) | last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    has_word = counts[ends] > counts[starts]
    starts, ends = starts[has_word], ends[has_word]
    sums, (_, down) = w.sums(), powers(len(buf) + 1)
    line = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(w.doc_start, starts, "right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    order = np.lexsort((line, doc))
    later = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][later], minlength=n)

    # words in windows of 8 that the document has twice or more
    out["n_repeat_words"] = np.zeros(n, np.int64)
    ids, doc = w.ids(), w.doc
    out["n_echo"] = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    grams = gram_ids(ids, WINDOW)
    if len(grams):
        at = np.flatnonzero(doc[: len(grams)] == doc[WINDOW - 1 :])
        twice = at[_repeats(doc[at], grams[at])]
        cover = np.zeros(len(doc) + 1, np.int32)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def measures(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the counts of each document."""
    picked = docs.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))
    kinds = [f.dataType.simpleString() for f in picked.schema.fields[:-1]]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(f"key{i}", arrow[k]) for i, k in enumerate(kinds)] + [(c, pa.int64()) for c in _COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(len(kinds)))
            parts = [measure_block(Words(data, offsets, a, b)) for a, b in blocks(offsets)]
            if parts:
                columns = {c: pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in _COUNTS}
                yield arrow_rows(schema, **{f"key{i}": batch.column(i).cast(arrow[k]) for i, k in enumerate(kinds)}, **columns)

    ddl = ", ".join([f"key{i} {k}" for i, k in enumerate(kinds)] + [f"{c} long" for c in _COUNTS])
    return picked.mapInArrow(run, ddl).withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})


def rates(measured: DataFrame) -> DataFrame:
    """The measures that the cuts are about, and the base rule."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return measured.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"), (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"), (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_punct") / chars).alias("punct_ratio"), (F.col("n_digits") / chars).alias("digit_ratio"), (F.col("n_echo") / n).alias("echo_ratio"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def sketches(rated: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bucket, n): one mergeable sketch for each group and measure, over documents that pass the base rule."""
    items = F.array(*[F.struct(F.lit(m).alias("measure"), F.ceil(F.log(F.col(m) + _OFFSET) / math.log(_GAMMA)).cast("int").alias("bucket")) for m in MEASURES])
    return rated.where("not base_failed").select(*groups, F.explode(items).alias("x")).groupBy(*groups, F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, n_docs, q1, q3) of merged sketches."""
    whole = Window.partitionBy(*groups, "measure")
    value = F.greatest(F.pow(F.lit(_GAMMA), F.col("bucket")) * (2 / (1 + _GAMMA)) - _OFFSET, F.lit(0.0))
    cumulated = sketch.select("*", F.sum("n").over(whole.orderBy("bucket")).alias("upto"), F.sum("n").over(whole).alias("total"), value.alias("value"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    return cumulated.groupBy(*groups, "measure").agg(F.max("total").alias("n_docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def cuts(rated: DataFrame) -> DataFrame:
    """(lang, source, cuts map<measure, struct<low, high>>) for each group that occurs."""
    base = sketches(rated, ["lang", "source"])
    low = lambda s: F.col("q1") - F.greatest(FENCE * (F.col("q3") - F.col("q1")), s)
    high = lambda s: F.col("q3") + F.greatest(FENCE * (F.col("q3") - F.col("q1")), s)

    def level(groups: list[str], name: str) -> DataFrame:
        slack = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
        q = quartiles(merged(base, groups), groups)
        return q.select(*groups, "measure", F.struct("n_docs", low(slack).alias("low"), high(slack).alias("high")).alias(name))

    own, by_lang, whole = level(["lang", "source"], "own"), level(["lang"], "by_lang"), level([], "whole")
    joined = own.join(by_lang.withColumnsRenamed({"lang": "lang2", "measure": "measure2"}), F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("measure2"))).join(whole.withColumnRenamed("measure", "measure3"), F.col("measure") == F.col("measure3"))
    chosen = F.when(F.col("own.n_docs") >= LEAST, F.col("own")).when(F.col("by_lang.n_docs") >= LEAST, F.col("by_lang")).otherwise(F.col("whole"))
    return joined.select("lang", "source", "measure", chosen.alias("cut")).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cut"))).alias("cuts"))


def judged(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: counts, rates, base_failed, kept."""
    names = {doc_id: "doc_id", lang: "lang", source: "source"}
    rated = rates(saved(measures(docs.withColumn(doc_id, F.col(doc_id).cast("long")), list(names), text).withColumnsRenamed(names)))
    cut = cuts(rated).withColumnsRenamed({"lang": "lang2", "source": "source2"})
    inside = [F.coalesce(F.col(m).between(F.col("cuts")[m]["low"], F.col("cuts")[m]["high"]), F.lit(True)) for m in MEASURES]
    verdict = inside[0]
    for x in inside[1:]:
        verdict &= x
    # one row for each (lang, source) group: small, but not provably so, hence no broadcast hint; AQE decides by the measured size
    return rated.join(cut, F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2")), "left").select("*", (~F.col("base_failed") & verdict).alias("kept")).drop("cuts", "lang2", "source2")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns that they came with.

    The verdict depends on the row's own content and its group's cuts; rows are
    matched by doc_id and a hash of the text, so rows that share a doc_id are judged one by one.
    """
    own = unused_prefix(docs)
    key = [f"{own}{x}" for x in ("id", "lang", "source")]
    marked = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rated = rates(saved(measures(marked, ["doc_id", "lang", "source", own]).withColumnRenamed(own, "hash")))
    cut = cuts(rated).withColumnsRenamed({"lang": "lang2", "source": "source2"})
    inside = [F.coalesce(F.col(m).between(F.col("cuts")[m]["low"], F.col("cuts")[m]["high"]), F.lit(True)) for m in MEASURES]
    verdict = ~F.col("base_failed")
    for x in inside:
        verdict &= x
    good = rated.join(cut, F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2")), "left").where(verdict).select(F.col("hash").alias(f"{own}hash"), *[F.col(a).alias(b) for a, b in zip(("doc_id", "lang", "source"), key)]).distinct()
    same = F.col(own) == F.col(f"{own}hash")
    for a, b in zip(("doc_id", "lang", "source"), key):
        same &= F.col(a).eqNullSafe(F.col(b))
    return marked.join(good, same, "left_semi").drop(own)
