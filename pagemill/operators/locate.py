"""Page localisation inside the chosen document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.retrieve import dense_scores

def _by_query():
    return Window.partitionBy("qid")



def _all_pages(tops: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, doc_id, page_num, score) of every page of each query's document."""
    return dense_scores(tops.select("qid", "doc_id").join(queries.select("qid", F.col("emb").alias("q_emb")), "qid").join(vectors, "doc_id")).select("qid", "doc_id", "page_num", "score")


def first_page(pages: DataFrame, tops: DataFrame) -> DataFrame:
    """First candidate page of the document; the first candidate if it has none."""
    joined = pages.join(tops.select("qid", F.col("doc_id").alias("top")), "qid", "left")
    order = _by_query().orderBy(F.coalesce(F.col("doc_id") == F.col("top"), F.lit(False)).desc(), "rank")
    return joined.withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", "doc_id", "page_num", "score")


def same_doc(pages: DataFrame, tops: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Best candidate page of the document for the (answer-augmented) query; the earlier if tied."""
    own = pages.join(tops.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").select("qid", "doc_id", "page_num", "rank")
    scored = dense_scores(own.join(queries.select("qid", F.col("emb").alias("q_emb")), "qid").join(vectors, ["doc_id", "page_num"], "left")).withColumn("score", F.coalesce("score", F.lit(-2.0)))
    order = _by_query().orderBy(F.round("score", 9).desc(), "rank")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", "doc_id", "page_num", "score")


def summary_then_answer(tops: DataFrame, questions: DataFrame, queries: DataFrame, summaries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """A shortlist by question and page summary, then the best page of it for the augmented query."""
    listed = _all_pages(tops, questions, summaries)
    short = listed.withColumn("place", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "page_num"))).where(F.col("place") <= k)
    margin = short.groupBy("qid").agg((F.max(F.when(F.col("place") == 1, F.col("score"))) - F.max(F.when(F.col("place") == 2, F.col("score")))).alias("page_margin"), F.count(F.lit(1)).alias("shortlist"))
    scored = dense_scores(short.select("qid", "doc_id", "page_num", "place").join(queries.select("qid", F.col("emb").alias("q_emb")), "qid").join(vectors, ["doc_id", "page_num"], "left")).withColumn("score", F.coalesce("score", F.lit(-2.0)))
    best = scored.withColumn("n", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "place"))).where("n = 1")
    return best.join(margin, "qid").select("qid", "doc_id", "page_num", "score", "page_margin", "shortlist")


def page_scores(tops: DataFrame, queries: DataFrame, vectors: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Every page of the document by its best segment, else its own vector, else -2."""
    own = _all_pages(tops, queries, vectors)
    if segments is None:
        return own
    best = _all_pages(tops, queries, segments).groupBy("qid", "doc_id", "page_num").agg(F.max("score").alias("best"))
    return own.join(best, ["qid", "doc_id", "page_num"], "left").select("qid", "doc_id", "page_num", F.coalesce("best", "score", F.lit(-2.0)).alias("score"))


def threshold(scores: DataFrame, candidates: DataFrame, delta: float = 0.02, most: int = 4) -> DataFrame:
    """Pages within ``delta`` of the best, at most ``most``, by their rank among the candidates."""
    near = scores.withColumn("top", F.max("score").over(_by_query())).where(F.round(F.col("top") - F.col("score"), 9) <= delta)
    short = near.withColumn("place", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "page_num"))).where(F.col("place") <= most)
    ranks = candidates.select("qid", "doc_id", "page_num", F.col("rank").alias("seen"))
    order = _by_query().orderBy(F.coalesce("seen", F.lit(1_000_000)), F.round("score", 9).desc(), "page_num")
    margin = F.max(F.when(F.col("place") == 1, F.col("score"))).over(_by_query()) - F.max(F.when(F.col("place") == 2, F.col("score"))).over(_by_query())
    ordered = short.join(ranks, ["qid", "doc_id", "page_num"], "left").withColumn("n", F.row_number().over(order)).withColumn("page_margin", margin).withColumn("shortlist", F.count(F.lit(1)).over(_by_query()))
    return ordered.where("n = 1").select("qid", "doc_id", "page_num", "score", "page_margin", "shortlist")


def locked_top_k(scores: DataFrame, k: int = 3, stage2_margin: float | None = 0.03) -> DataFrame:
    """Best k pages of the document, and whether the close call asks for a second stage."""
    listed = scores.withColumn("rank", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "page_num"))).where(F.col("rank") <= k)
    margin = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(_by_query()) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(_by_query())
    marked = listed.withColumn("page_margin", margin)
    close = F.lit(False) if stage2_margin is None else F.coalesce(F.round("page_margin", 9) < stage2_margin, F.lit(False))
    return marked.withColumn("stage2", close)
