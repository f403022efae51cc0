"""Leakage-safe splits by document.

The greedy choices are sequential by definition; they see one row per document of
the labelled questions, never questions or text, and run in one pandas group.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import int_or, question_order

BUCKETS = 4
#: Weights of the squared relative deviations.
DOCS_WEIGHT, QUESTIONS_WEIGHT, DOMAIN_WEIGHT, BUCKET_WEIGHT = 4.0, 3.0, 2.0, 1.0


def doc_records(questions: DataFrame) -> DataFrame:
    """M1, M2: one row per document: questions, pages, domain of the first question, length bucket."""
    first = F.row_number().over(Window.partitionBy("Doc_ID").orderBy(*question_order("Question_ID")))
    docs = questions.withColumn("_n", first).groupBy(F.col("Doc_ID").alias("doc_id")).agg(F.max(F.when(F.col("_n") == 1, F.coalesce("Domain", F.lit("unknown")))).alias("domain"), F.max(int_or("N_Pages", 1)).alias("n_pages"), F.count(F.lit(1)).alias("question_count"))
    # the place of a document by pages and id: the documents with fewer pages, and its place among those with as many
    sizes = docs.groupBy("n_pages").agg(F.count(F.lit(1)).alias("same"))
    upto = sizes.select(F.col("n_pages").alias("_p"), (F.sum("same").over(Window.orderBy("n_pages")) - F.col("same")).alias("fewer"), F.sum("same").over(Window.partitionBy()).alias("every"))
    placed = docs.join(upto, F.col("n_pages") == F.col("_p")).withColumn("place", F.col("fewer") + F.row_number().over(Window.partitionBy("n_pages").orderBy("doc_id")) - 1)
    size = F.greatest(F.lit(1), F.ceil(F.col("every") / BUCKETS))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.col("place") / size)) + 1
    return placed.select("doc_id", "domain", "n_pages", "question_count", F.concat(F.lit("q"), bucket.cast("string")).alias("length_bucket"))


def round_robin(docs: DataFrame) -> DataFrame:
    """M6: order in which documents are dealt: one of each (domain, bucket) stratum in turn."""
    inside = Window.partitionBy("domain", "length_bucket").orderBy(F.desc("question_count"), F.desc("n_pages"), "domain", "doc_id")
    return docs.withColumn("turn", F.row_number().over(inside)).withColumn("deal", F.row_number().over(Window.orderBy("turn", "domain", "length_bucket")))


def _ordered(pdf: pd.DataFrame) -> list[dict]:
    return pdf.sort_values(["question_count", "n_pages", "domain", "doc_id"], ascending=[False, False, True, True]).to_dict("records")


def pick_balanced(docs: list[dict], size: int) -> list[dict]:
    """M3 to M5: documents chosen one by one, each time the one that leaves the subset nearest its targets.

    Documents of one domain, bucket and number of questions change the subset alike, so each step looks at the first of each such
    class only (most pages, then id), and the work is that of steps times classes.
    """
    if size <= 0:
        return []
    if size >= len(docs):
        return list(docs)
    ratio = size / len(docs)
    want_q = ratio * sum(d["question_count"] for d in docs)
    want = {kind: {k: n * ratio for k, n in Counter(d[kind] for d in docs).items()} for kind in ("domain", "length_bucket")}
    weights = {"domain": DOMAIN_WEIGHT, "length_bucket": BUCKET_WEIGHT}
    have: dict[str, Counter] = {"domain": Counter(), "length_bucket": Counter()}
    alike: dict[tuple, list[dict]] = {}
    # in reverse, so that the first one of a class is its last
    for d in sorted(sorted(docs, key=lambda d: d["doc_id"], reverse=True), key=lambda d: d["n_pages"]):
        alike.setdefault((d["domain"], d["length_bucket"], d["question_count"]), []).append(d)
    chosen: list[dict] = []
    n_questions = 0

    def off(value: float, target: float) -> float:
        return ((value - target) / max(target, 1.0)) ** 2

    while len(chosen) < size:

        def cost(key: tuple) -> tuple:
            total = DOCS_WEIGHT * off(len(chosen) + 1, size) + QUESTIONS_WEIGHT * off(n_questions + key[2], want_q)
            for kind, own in (("domain", key[0]), ("length_bucket", key[1])):
                total += sum(weights[kind] * off(have[kind][k] + (own == k), t) for k, t in want[kind].items())
            first = alike[key][-1]
            return total, -key[2], -first["n_pages"], first["doc_id"]

        best = min(alike, key=cost)
        d = alike[best].pop()
        if not alike[best]:
            del alike[best]
        chosen.append(d)
        n_questions += best[2]
        have["domain"][best[0]] += 1
        have["length_bucket"][best[1]] += 1
    return chosen


def deal(docs: list[dict], groups: int) -> dict[str, int]:
    """M6: each document, in round-robin order, to the group with least of its domain, bucket, questions, documents."""
    strata: dict[tuple, list[dict]] = {}
    for d in docs:
        strata.setdefault((d["domain"], d["length_bucket"]), []).append(d)
    turns = sorted((i, key) for key, rows in strata.items() for i in range(len(rows)))
    loads = [[Counter(), Counter(), 0, 0] for _ in range(groups)]
    out = {}
    for i, key in turns:
        d = strata[key][i]
        g = min(range(groups), key=lambda g: (loads[g][0][d["domain"]], loads[g][1][d["length_bucket"]], loads[g][2], loads[g][3], g))
        loads[g][0][d["domain"]] += 1
        loads[g][1][d["length_bucket"]] += 1
        loads[g][2] += d["question_count"]
        loads[g][3] += 1
        out[d["doc_id"]] = g
    return out


def protocol(docs: DataFrame, folds: int = 5, lockbox_ratio: float = 0.2, val_ratio: float = 0.2) -> DataFrame:
    """M5 to M8: (doc_id, role, fold, legacy): lockbox or the fold in which a document is validated, and the legacy split."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        every = _ordered(pdf)
        n = min(max(1, round(len(every) * lockbox_ratio)), max(0, len(every) - folds))
        locked = {d["doc_id"] for d in pick_balanced(every, n)}
        rest = [d for d in every if d["doc_id"] not in locked]
        fold = deal(rest, folds)
        val = {d["doc_id"] for d in pick_balanced(rest, min(max(1, round(len(rest) * val_ratio)), max(0, len(rest) - 1)))}
        rows = [(d["doc_id"], "lockbox" if d["doc_id"] in locked else "cv", fold.get(d["doc_id"], -1), "none" if d["doc_id"] in locked else "val" if d["doc_id"] in val else "train") for d in every]
        return pd.DataFrame(rows, columns=["doc_id", "role", "fold", "legacy"])

    return docs.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "doc_id string, role string, fold int, legacy string")


def leave_one_domain_out(questions: DataFrame) -> DataFrame:
    """M9: (held_out, Question_ID, role): every question once per domain."""
    domains = questions.select(F.col("Domain").alias("held_out")).distinct()
    return questions.select("Question_ID", "Domain").crossJoin(domains).select("held_out", "Question_ID", F.when(F.col("Domain") == F.col("held_out"), "val").otherwise("train").alias("role"))


def split_rows(questions: DataFrame, assignment: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """M8: (train, val) questions of one fold."""
    cv = assignment.where("role = 'cv'").select(F.col("doc_id").alias("Doc_ID"), "fold")
    val = cv.where(F.col("fold") == fold)
    return questions.join(cv.where(F.col("fold") != fold), "Doc_ID", "left_semi"), questions.join(val, "Doc_ID", "left_semi")


def summary(docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Documents and questions by role, fold, domain and bucket."""
    return docs.join(assignment, "doc_id").groupBy("role", "fold", "domain", "length_bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("question_count").alias("n_questions"))
