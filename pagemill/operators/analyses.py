"""Published analyses as operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.metrics import quantile

DISTANCES = (1, 2, 3, 5, 10)
# The classes of the error taxonomy, and the limits of the risk filter.
CLASSES = ("all_correct", "only_page_wrong", "only_doc_right", "only_answer_right", "only_answer_wrong", "all_wrong")
MAX_FLIP, MAX_DOMAIN_DELTA = 0.05, 0.01


def draw(*parts: Column | str) -> Column:
    """A 32-bit number from the MD5 of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("long")


ITERATIONS = 10_000
#: Where a uniform 32-bit number stops to stand for 0, 1, ... 8 occurrences of a Poisson variable of mean 1.
POISSON = tuple(round(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(w + 1))) for w in range(9))
#: Step between resamples, and the factors of the 32-bit mixing of key and resample.
STEP, FACTORS = 2654435761, (2246822507, 3266489909)
_ROWS = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in zip((16, 13), FACTORS):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def occurrences(a: np.ndarray, b: np.ndarray, iterations: int) -> np.ndarray:
    """How often each row, given by the two halves of its key, occurs in each resample."""
    steps = np.arange(iterations, dtype=np.uint32) * np.uint32(STEP)
    u = _mixed(_mixed(a[:, None] + steps) ^ b[:, None])
    out = np.zeros(u.shape, np.uint8)
    for t in POISSON:
        out += u >= np.uint32(t)
    return out


def bootstrap_metrics(deltas: DataFrame, names: list[str], iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """(metric, delta, n, low, high) of each column of ``names``: its mean and 95 % interval over resamples; ``i`` is the key of a row.

    A row occurs in each resample as often as a Poisson variable of mean 1 says, drawn by the hash of its key and the resample, for all
    metrics alike.  A task holds one vector of ``iterations`` sums for each metric and sends it on once, whatever number of rows it has
    seen; sums of sums follow as a plain aggregation.  Nulls of a metric are left out of it; without any value ``delta``, ``low`` and
    ``high`` are null and ``n`` is 0.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string")))
    half = lambda at: F.conv(F.substring("key", at, 8), 16, 10).cast("long")
    keyed = deltas.select(key.alias("key"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(names)]).select(half(1).alias("a"), half(9).alias("b"), *[f"x{j}" for j in range(len(names))])
    fields = [(f"{kind}{j}", pa.float64()) for j in range(len(names)) for kind in ("s", "w")]
    schema = pa.schema([("resample", pa.int32()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * len(names), iterations))
        seen = 0
        for batch in batches:
            a, b = (np.asarray(batch.column(c)).astype(np.uint32) for c in (0, 1))
            x = np.array([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(len(names))], np.float64).reshape(len(names), -1)
            known = np.array([batch.column(2 + j).is_valid().to_numpy(zero_copy_only=False) for j in range(len(names))]).reshape(len(names), -1)
            both = np.empty((2 * len(names), len(a)))
            both[::2], both[1::2] = np.where(known, x, 0.0), known
            for at in range(0, len(a), _ROWS):
                total += both[:, at : at + _ROWS] @ occurrences(a[at : at + _ROWS], b[at : at + _ROWS], iterations).astype(np.float64)
            seen += len(a)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations, dtype=np.int32)), *map(pa.array, total)], schema=schema)

    sums = keyed.mapInArrow(run, "resample int, " + ", ".join(f"{c} double" for c, _ in fields)).groupBy("resample").agg(*[F.sum(c).alias(c) for c, _ in fields])
    ends = sums.agg(*[F.percentile(F.try_divide(F.col(f"s{j}"), F.col(f"w{j}")), F.array(F.lit(0.025), F.lit(0.975))).alias(f"e{j}") for j in range(len(names))])
    point = deltas.agg(*[F.struct(F.avg(c).alias("delta"), F.count(c).alias("n")).alias(f"p{j}") for j, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("metric"), F.col(f"p{j}.delta").cast("double").alias("delta"), F.col(f"p{j}.n").alias("n"), F.get(f"e{j}", F.lit(0)).alias("low"), F.get(f"e{j}", F.lit(1)).alias("high")) for j, c in enumerate(names)]
    return point.crossJoin(ends).select(F.inline(F.array(*rows)))


def bootstrap(deltas: DataFrame, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """N1 for one metric: (delta, n, low, high) of (i, delta) rows."""
    return bootstrap_metrics(deltas, ["delta"], iterations, seed).drop("metric")


#: The four metrics of a run, as columns of scored questions.
METRICS = {"answer": "answer_correct", "doc": "doc_correct", "page": "page_proximity", "composite": "score"}


def metric_deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, answer, doc, page, composite): change of each metric at each question that both runs (scored questions) have."""
    a = left.select("Question_ID", *[F.col(c).alias(f"a_{m}") for m, c in METRICS.items()])
    b = right.select("Question_ID", *[F.col(c).alias(f"b_{m}") for m, c in METRICS.items()])
    return a.join(b, "Question_ID").select(F.col("Question_ID").alias("i"), *[F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 9).alias(m) for m in METRICS])


def page_distances(scored: DataFrame, thresholds: tuple[int, ...] = DISTANCES) -> DataFrame:
    """Distances of wrong pages in right documents, over all and by domain, all of them from the counts of each distance."""
    wrong = scored.where((F.col("doc_correct") == 1) & (F.col("pred_page") != F.col("true_page"))).withColumn("dist", F.abs(F.col("pred_page") - F.col("true_page")))
    counted = wrong.groupBy("Domain", "dist").agg(F.count(F.lit(1)).alias("w"))
    both = counted.groupingSets([[F.col("dist")], [F.col("Domain"), F.col("dist")]], F.col("Domain"), F.col("dist")).agg(F.sum("w").alias("w"), F.grouping("Domain").alias("g"))
    near = [(F.sum(F.when(F.col("dist") <= t, F.col("w")).otherwise(0)) / F.sum("w")).alias(f"within_{t}") for t in thresholds]
    out = quantile(both, "dist", "g", "Domain").groupBy("g", "Domain").agg(F.sum("w").alias("n"), *near, F.max("quantile").alias("median"), (F.sum(F.col("w") * F.col("dist")) / F.sum("w")).alias("mean"))
    return out.withColumn("Domain", F.when(F.col("g") == 1, "all").otherwise(F.col("Domain"))).drop("g")


def vote_consistency(votes: DataFrame, correct: DataFrame) -> DataFrame:
    """Share and accuracy of unanimous, majority and all-different votes."""
    kinds = votes.groupBy("qid").agg(F.count_distinct("letter").alias("d"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("d") == 1, "unanimous").when(F.col("d") == F.col("n"), "all_different").otherwise("majority")
    by = kinds.join(correct, "qid").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def stage_lift(report: DataFrame, before: str, after: str) -> DataFrame:
    """Change of the rank metrics from one stage to another, by domain."""
    a = report.where(F.col("stage") == before).select("domain", F.col("mrr").alias("mrr_before"), F.col("recall_1").alias("recall_before"))
    b = report.where(F.col("stage") == after).select("domain", F.col("mrr").alias("mrr_after"), F.col("recall_1").alias("recall_after"))
    return a.join(b, "domain").select("*", (F.col("mrr_after") - F.col("mrr_before")).alias("mrr_lift"), (F.col("recall_after") - F.col("recall_before")).alias("recall_lift"))


def context_sweep(scored: DataFrame, sizes: tuple[int, ...] = (0, 1, 2, 3, 5), sample: int = 100, seed: int = 42) -> DataFrame:
    """Answers by context size on a hash sample of ``sample`` questions; ``scored``: (qid, rank of the evidence page or null).

    The sampling is the feature; a question counts as answerable if its evidence is in the context.
    """
    chosen = scored.orderBy(draw(F.lit(str(seed)), F.col("qid").cast("string")), "qid").limit(sample)
    grid = chosen.withColumn("k", F.explode(F.array(*map(F.lit, sizes))))
    return grid.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("double")).alias("accuracy"))


def domain_deltas(diff: DataFrame, domains: list[str]) -> DataFrame:
    """Mean score change with one column per domain."""
    return diff.groupBy(F.lit("delta").alias("metric")).pivot("Domain", domains).agg(F.avg("delta"))


def error_class() -> Column:
    """One of six classes of a scored question."""
    a, d, p = F.col("answer_correct") == 1, F.col("doc_correct") == 1, F.col("page_proximity") == 1
    return F.when(a & d & p, "all_correct").when(a & d, "only_page_wrong").when(a, "only_answer_right").when(d & p, "only_answer_wrong").when(d, "only_doc_right").otherwise("all_wrong")


def error_taxonomy(scored: DataFrame) -> DataFrame:
    by = scored.groupBy(error_class().alias("error")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def risk_filter(summary: DataFrame, long_doc_rule: bool = False) -> DataFrame:
    """(doc_flip, worst_domain, safe) of a run diff summary."""
    whole = F.max(F.when(F.col("Domain") == "all", F.col("doc_changed_rate")))
    worst = F.max(F.when(F.col("Domain") != "all", F.abs("mean_delta")))
    return summary.agg(whole.alias("doc_flip"), worst.alias("worst_domain")).withColumn("safe", (F.round("doc_flip", 9) < MAX_FLIP) & (F.round("worst_domain", 9) <= MAX_DOMAIN_DELTA) & F.lit(not long_doc_rule))


def promotion_gate(deltas: DataFrame) -> DataFrame:
    """(candidate, promoted): better on every split."""
    return deltas.groupBy("candidate").agg(F.bool_and(F.col("delta") > 0).alias("promoted"), F.count(F.lit(1)).alias("splits"))


def ablation_ledger(runs: DataFrame, baseline: str) -> DataFrame:
    """Composite of each (system, split) and its change against the baseline on that split."""
    base = runs.where(F.col("system") == baseline).select("split", F.col("composite").alias("base"))
    return runs.join(base, "split", "left").withColumn("delta", F.col("composite") - F.col("base")).drop("base")


def leaderboard(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote scores with the local one where it is known."""
    return remote.join(local, "system", "left").select("system", "local", "public", "private", (F.col("public") - F.col("local")).alias("public_delta"), (F.col("private") - F.col("local")).alias("private_delta"))


def corpus_stats(pages: DataFrame, short: int = 50) -> DataFrame:
    """Documents, pages, pages per document and short pages, by domain and over all."""
    per_doc = pages.groupBy("domain", "doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length("text") < short).alias("short"))
    out = per_doc.groupingSets([[], [F.col("domain")]], F.col("domain")).agg(F.count(F.lit(1)).alias("docs"), F.sum("pages").alias("pages"), F.sum("short").alias("short_pages"), F.grouping("domain").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("domain")).alias("domain"), "docs", "pages", (F.col("pages") / F.col("docs")).alias("pages_per_doc"), "short_pages")
