"""Document rankings, margins, guards, locks and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import NO_TEXT, strip, tokens
from pagemill.operators.retrieve import dense_scores

def _by_query():
    return Window.partitionBy("qid")



def doc_ranking(pages: DataFrame) -> DataFrame:
    """Each document at the place, and with the score, of its first page."""
    docs = pages.groupBy("qid", "doc_id").agg(F.min("rank").alias("first"), F.min_by("score", "rank").alias("score"))
    return docs.withColumn("rank", F.row_number().over(_by_query().orderBy("first"))).drop("first")


def guarded_ranking(pages: DataFrame, top_pages: int = 2, weight: float = 0.35) -> DataFrame:
    """First page's score plus ``weight`` times those of the next ``top_pages`` - 1 pages."""
    inside = Window.partitionBy("qid", "doc_id").orderBy("rank")
    numbered = pages.withColumn("n", F.row_number().over(inside)).where(F.col("n") <= top_pages)
    docs = numbered.groupBy("qid", "doc_id").agg(F.sum(F.when(F.col("n") == 1, F.col("score")).otherwise(weight * F.col("score"))).alias("score"), F.min("rank").alias("first"))
    return docs.withColumn("rank", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "first"))).drop("first")


def top_margin() -> Column:
    """Score of rank 1 less that of rank 2; null without a second."""
    return F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))


def margins(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("qid").agg(top_margin().alias("margin"))


def lock_flags(pages: DataFrame, doc_meta: DataFrame, min_pages: int = 0, min_margin: float | None = None, enabled: bool = True) -> DataFrame:
    """(qid, top_doc, margin, n_pages, locked); the margin is between pages and has to be exceeded."""
    tops = pages.groupBy("qid").agg(F.max_by("doc_id", -F.col("rank")).alias("top_doc"), top_margin().alias("margin"))
    joined = tops.join(doc_meta.select(F.col("doc_id").alias("top_doc"), "n_pages"), "top_doc", "left")
    pages_ok = F.coalesce("n_pages", F.lit(0)) >= min_pages
    margin_ok = F.lit(True) if min_margin is None else F.coalesce(F.col("margin") > min_margin, F.lit(False))
    return joined.select("qid", "top_doc", "margin", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), (F.lit(enabled) & pages_ok & margin_ok).alias("locked"))


def locked_order(pages: DataFrame, flags: DataFrame) -> DataFrame:
    """E5: where locked, pages of the locked document first; both parts in the order they had."""
    joined = pages.join(flags.select("qid", "top_doc", "locked"), "qid")
    other = F.col("locked") & (F.col("doc_id") != F.col("top_doc"))
    return joined.withColumn("rank", F.row_number().over(_by_query().orderBy(other, "rank"))).drop("top_doc", "locked")


def exhaustive_lock(pages: DataFrame, flags: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Where locked, all pages of the locked document by dense score, then the other documents' pages."""
    locked = flags.where("locked").select("qid", F.col("top_doc").alias("doc_id"))
    full = dense_scores(locked.join(queries.select("qid", F.col("emb").alias("q_emb")), "qid").join(vectors, "doc_id"))
    inside = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "page_num")
    first = full.select("qid", "doc_id", "page_num", "score", F.lit(0).alias("part"), F.row_number().over(inside).alias("rank"))
    rest = pages.join(locked, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "page_num", "score", F.lit(1).alias("part"), "rank")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(_by_query().orderBy("part", "rank"))).drop("part")


def guard_changed(pages: DataFrame, top_pages: int = 2, weight: float = 0.35) -> DataFrame:
    """(qid, plain_top, guarded_top, changed)."""
    plain = doc_ranking(pages).where("rank = 1").select("qid", F.col("doc_id").alias("plain_top"))
    guarded = guarded_ranking(pages, top_pages, weight).where("rank = 1").select("qid", F.col("doc_id").alias("guarded_top"))
    return plain.join(guarded, "qid").withColumn("changed", F.col("plain_top") != F.col("guarded_top"))


def doc_previews(pages: DataFrame, texts: DataFrame, most_docs: int = 6, preview_pages: int = 2, page_chars: int = 4000) -> DataFrame:
    """First documents with the score of their first page and a preview of their first pages."""
    docs = doc_ranking(pages).where(F.col("rank") <= most_docs)
    inside = Window.partitionBy("qid", "doc_id").orderBy("rank")
    shown = pages.withColumn("n", F.row_number().over(inside)).where(F.col("n") <= preview_pages).select("qid", "doc_id", "page_num", "n")
    text = strip(F.coalesce("text", F.lit("")))
    part = F.when(text != "", F.concat(F.format_string("[Page %d]\n", F.col("page_num").cast("int")), F.left(text, F.lit(page_chars // max(preview_pages, 1)))))
    built = shown.join(texts, ["doc_id", "page_num"], "left").select("qid", "doc_id", "n", part.alias("part")).groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("n", "part")))).alias("parts"))
    preview = F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n")
    return docs.join(built, ["qid", "doc_id"], "left").select("qid", "doc_id", "score", "rank", F.when(F.coalesce(preview, F.lit("")) == "", NO_TEXT).otherwise(preview).alias("preview"))


def skip_flags(pages: DataFrame, top_n: int = 3, margin: float = 0.035) -> DataFrame:
    """(qid, skip): one page, one document, or the first n of one document and far enough ahead."""
    top = pages.withColumn("top", F.first("doc_id").over(_by_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = F.count_if((F.col("rank") <= top_n) & (F.col("doc_id") == F.col("top")))
    lead = F.max(F.when(F.col("rank") == 1, F.col("score")))
    other = F.min_by(F.when(F.col("doc_id") != F.col("top"), F.col("score")), F.when(F.col("doc_id") != F.col("top"), F.col("rank")))
    flags = top.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), same.alias("same"), lead.alias("lead"), other.alias("other"))
    return flags.select("qid", ((F.col("n") <= 1) | F.col("other").isNull() | ((F.col("same") >= top_n) & (F.round(F.col("lead") - F.col("other"), 9) >= margin))).alias("skip"))


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Deterministic stand-in for a cross-encoder: share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def rerank_pages(pages: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """F1: pages by the score of (question, page text); equal scores stay in order; no model, no change."""
    if scorer is None:
        return pages
    pairs = pages.join(queries.select("qid", "question"), "qid").join(texts.select("doc_id", "page_num", "text"), ["doc_id", "page_num"], "left")
    scored = pairs.select("qid", "doc_id", "page_num", scorer(F.col("question"), F.coalesce("text", F.lit(""))).alias("score"), F.col("rank").alias("before"))
    return scored.withColumn("rank", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "before"))).drop("before")


def yes_probability(no: Column | str, yes: Column | str) -> Column:
    """Softmax over the two logits."""
    no, yes = (F.col(x) if isinstance(x, str) else x for x in (no, yes))
    return 1 / (1 + F.exp(no - yes))


def rerank_docs(previews: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] | None = overlap_score) -> DataFrame:
    """F2: documents by the score of (question, preview)."""
    if scorer is None:
        return previews.select("qid", "doc_id", "score", "rank")
    scored = previews.join(queries.select("qid", "question"), "qid").select("qid", "doc_id", scorer(F.col("question"), F.col("preview")).alias("score"), F.col("rank").alias("before"))
    return scored.withColumn("rank", F.row_number().over(_by_query().orderBy(F.round("score", 9).desc(), "before"))).drop("before")


def rerank_docs_unless_sure(pages: DataFrame, texts: DataFrame, queries: DataFrame, top_n: int = 3, margin: float = 0.035, scorer: Callable[[Column, Column], Column] | None = overlap_score, **preview) -> DataFrame:
    """F3 in document mode: sure queries keep their ranking, the others pay for the model ``scorer``; adds ``skipped``."""
    flags = skip_flags(pages, top_n, margin)
    sure = flags.where("skip").select("qid")
    kept = doc_ranking(pages.join(sure, "qid", "left_semi")).select("qid", "doc_id", "score", "rank", F.lit(True).alias("skipped"))
    again = rerank_docs(doc_previews(pages.join(sure, "qid", "left_anti"), texts, **preview), queries, scorer).select("qid", "doc_id", "score", "rank", F.lit(False).alias("skipped"))
    return kept.unionByName(again)


def rerank_changes(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, skipped, changed): whether the model put another document first; ``docs`` as ``rerank_docs_unless_sure`` returns it."""
    before = doc_ranking(pages).where("rank = 1").select("qid", F.col("doc_id").alias("before"))
    return docs.where("rank = 1").join(before, "qid").select("qid", "skipped", (~F.col("skipped") & (F.col("doc_id") != F.col("before"))).alias("changed"))
