"""Scores of predictions and rankings.

Averages over all and by domain come from one aggregation with grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import int_or, strip

CUTS = (1, 3, 5, 10)


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows as a keyed table that later rows overwrite: the last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def proximity(pred: Column, true: Column, n_pages: Column) -> Column:
    """1 less the share of the document's pages between the two, not under 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(pred - true) / F.greatest(n_pages, F.lit(1)))


def score_questions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """K1: one row per prediction that has a question."""
    t = truth.select("Question_ID", F.coalesce("Domain", F.lit("unknown")).alias("Domain"), int_or("N_Pages", 1, 1).alias("n_pages"), strip("Correct_Answer").alias("true_answer"), strip("Doc_ID").alias("true_doc"), int_or("Page_Num", 1).alias("true_page"))
    p = predictions.select("Question_ID", strip("Correct_Answer").alias("pred_answer"), strip("Doc_ID").alias("pred_doc"), int_or("Page_Num", 1).alias("pred_page"))
    doc_ok = F.col("true_doc") == F.col("pred_doc")
    near = F.when(doc_ok, proximity(F.col("pred_page"), F.col("true_page"), F.col("n_pages"))).otherwise(0.0)
    scored = t.join(p, "Question_ID").select("*", (F.col("true_answer") == F.col("pred_answer")).cast("double").alias("answer_correct"), doc_ok.cast("double").alias("doc_correct"), near.alias("page_proximity"))
    return scored.withColumn("score", 0.5 * F.col("answer_correct") + 0.25 * F.col("doc_correct") + 0.25 * F.col("page_proximity"))


def evaluate(scored: DataFrame) -> DataFrame:
    """K2: (scope, n, answer, doc, page, composite) over all (zeros without any row) and by domain.

    Questions are added up once by domain; the total is made from these few rows.
    """
    names = {"answer": "answer_correct", "doc": "doc_correct", "page": "page_proximity", "composite": "score"}
    by = scored.groupBy(F.col("Domain").alias("scope")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for a, c in names.items()])
    whole = by.agg(F.lit("all").alias("scope"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(a), F.lit(0.0)).alias(a) for a in names])
    return whole.unionByName(by).select("scope", "n", *[(F.col(a) / F.greatest("n", F.lit(1))).alias(a) for a in names])


def rank_of(rankings: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """K3: rank of the true item of each query; null if it is not in the ranking."""
    hit = rankings.join(truth, ["qid", *keys], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return truth.join(hit, "qid", "left")


def quantile(counted: DataFrame, value: str, *keys: str, share: float = 0.5, weight: str = "w") -> DataFrame:
    """``counted`` with the exact quantile of its counted values by ``keys`` in ``quantile``, interpolated between neighbours.

    ``counted`` has one row for each key and value, and the number of times it occurs in ``weight``: counts that any number of tasks
    can add up, so that no row of the data itself is sorted or held.  Null values have no place in the order.
    """
    known = F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0)
    by = Window.partitionBy(*keys)
    upto = F.sum(known).over(by.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_upto", upto).withColumn("_at", share * (F.sum(known).over(by) - 1))
    # the first value whose running count passes a place stands there
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value))).over(by).cast("double")
    low, high = at(F.floor("_at")), at(F.ceil("_at"))
    return placed.withColumn("quantile", low + (high - low) * (F.col("_at") - F.floor("_at"))).drop("_upto", "_at")


def rank_metrics(counted: DataFrame, *keys: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """K4: rank metrics by ``keys`` of (keys, nullable ``rank``, ``w``) rows, one for each rank with the number of its queries."""
    rank, w = F.col("rank"), F.col("w")
    zero, n, found = F.lit(0.0), F.sum("w"), F.sum(F.when(F.col("rank").isNotNull(), F.col("w")).otherwise(0))
    mean = lambda c: F.try_divide(F.sum(w * F.coalesce(c, zero)), n)
    return quantile(counted, "rank", *keys).groupBy(*keys).agg(
        F.coalesce(n, F.lit(0)).alias("n"), mean(1 / rank).alias("mrr"), mean(1 / F.log2(rank + 1)).alias("ndcg"), F.try_divide(found.cast("double"), n).alias("found"),
        F.coalesce(F.try_divide(F.sum(w * rank).cast("double"), found), zero).alias("mean_rank_found"), F.max("quantile").alias("median_rank_found"), *[mean((rank <= k).cast("double")).alias(f"recall_{k}") for k in cuts],
    )


def ir_report(ranked: DataFrame) -> DataFrame:
    """K6: rank metrics of (stage, domain, rank) rows by stage, over all and by domain.

    Queries are counted once by stage, domain and rank; everything else is made of these counts.
    """
    counted = ranked.groupBy("stage", "domain", "rank").agg(F.count(F.lit(1)).alias("w"))
    sets = [[F.col("stage"), F.col("rank")], [F.col("stage"), F.col("domain"), F.col("rank")]]
    both = counted.groupingSets(sets, F.col("stage"), F.col("domain"), F.col("rank")).agg(F.sum("w").alias("w"), F.grouping("domain").alias("g"))
    out = rank_metrics(both, "stage", "g", "domain")
    return out.withColumn("domain", F.when(F.col("g") == 1, "all").otherwise(F.col("domain"))).drop("g")


def proximity_at(rankings: DataFrame, truth: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """K5: mean over queries of the best proximity in the first k pages, if they are of the right document."""
    hit = rankings.join(truth.select("qid", F.col("doc_id").alias("true_doc"), "true_page", "n_pages"), "qid").where("doc_id = true_doc")
    near = proximity(F.col("page_num"), F.col("true_page"), F.col("n_pages"))
    best = hit.groupBy("qid").agg(*[F.max(F.when(F.col("rank") <= k, near)).alias(f"p{k}") for k in cuts])
    return truth.select("qid").join(best, "qid", "left").agg(*[F.avg(F.coalesce(f"p{k}", F.lit(0.0))).alias(f"proximity_{k}") for k in cuts])


def counters(flags: DataFrame, *names: str) -> DataFrame:
    """K9, H2: number of questions and of those with each flag."""
    return flags.agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(F.col(c)).alias(c) for c in names])


def report(evaluated: DataFrame) -> str:
    """K8: the averages as text, all questions first."""
    rows = sorted(evaluated.collect(), key=lambda r: (r["scope"] != "all", r["scope"]))
    return "\n".join(f"{r['scope']}: n={r['n']} answer={r['answer']:.4f} doc={r['doc']:.4f} page={r['page']:.4f} composite={r['composite']:.4f}" for r in rows)


def random_baseline(truth: DataFrame, seed: int = 42) -> DataFrame:
    """K7: a document of the same domain, a letter and a page, drawn by hashes of the question."""
    draw = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), "Question_ID")), 1, 8), 16, 10).cast("long")
    docs = truth.groupBy("Domain", "Doc_ID").agg(F.max(int_or("N_Pages", 1, 1)).alias("n_pages"))
    numbered = docs.withColumn("i", F.row_number().over(Window.partitionBy("Domain").orderBy("Doc_ID")) - 1)
    sizes = docs.groupBy("Domain").agg(F.count(F.lit(1)).alias("n_docs"))
    picked = truth.select("Question_ID", "Domain").join(sizes, "Domain").withColumn("i", draw("doc") % F.col("n_docs"))
    letter = F.element_at(F.array(*map(F.lit, "ABCDEF")), (draw("letter") % 6 + 1).cast("int"))
    return picked.join(numbered, ["Domain", "i"]).select("Question_ID", letter.alias("Correct_Answer"), "Doc_ID", (draw("page") % F.col("n_pages") + 1).cast("string").alias("Page_Num"))
