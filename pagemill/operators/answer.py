"""Context assembly, votes, number of passes and the runtime governor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import NO_CONTEXT, PAGE_TAG, strip
from pagemill.sources.scratch import scratch_path, written


def doc_mode_order(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages regrouped by document rank; documents without a rank after the others, in the order of their pages."""
    joined = pages.join(docs.select("qid", "doc_id", F.col("rank").alias("doc_rank")), ["qid", "doc_id"], "left")
    first = F.min("rank").over(Window.partitionBy("qid", "doc_id"))
    order = Window.partitionBy("qid").orderBy(F.col("doc_rank").asc_nulls_last(), "first", "rank")
    return joined.withColumn("first", first).withColumn("rank", F.row_number().over(order)).drop("doc_rank", "first")


def build_context(pages: DataFrame, texts: DataFrame, most_pages: int = 4, page_chars: int = 3500) -> DataFrame:
    """G1: (qid, context): first pages with text, each once and cut, joined by empty lines."""
    if most_pages <= 0:
        return pages.select("qid").distinct().withColumn("context", F.lit(""))
    text = strip(F.coalesce("text", F.lit("")))
    once = pages.groupBy("qid", "doc_id", "page_num").agg(F.min("rank").alias("rank"))
    filled = once.join(texts.select("doc_id", "page_num", "text"), ["doc_id", "page_num"], "left").withColumn("text", text).where("text <> ''")
    picked = filled.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= most_pages)
    part = F.concat(F.format_string(PAGE_TAG + "\n", F.col("page_num").cast("int")), F.left("text", F.lit(page_chars)))
    built = picked.select("qid", "n", part.alias("part")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    return pages.select("qid").distinct().join(built, "qid", "left").select("qid", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def majority(votes: DataFrame) -> DataFrame:
    """(qid, letter, n_votes, confidence): most votes, the earliest if tied; share of the winner."""
    counted = votes.groupBy("qid", "letter").agg(F.count(F.lit(1)).alias("n"), F.min("pass_no").alias("first"))
    return counted.groupBy("qid").agg(F.max_by("letter", F.struct(F.col("n"), -F.col("first"))).alias("letter"), F.sum("n").alias("n_votes"), (F.max("n") / F.sum("n")).alias("confidence"))


def dual_votes(votes: DataFrame, other: DataFrame, contexts: DataFrame) -> DataFrame:
    """Votes on a second context, where it differs, come after those on the first."""
    differs = contexts.where("context <> other_context").select("qid")
    more = other.join(differs, "qid", "left_semi")
    last = votes.groupBy("qid").agg(F.max("pass_no").alias("last"))
    return votes.select("qid", "pass_no", "letter").unionByName(more.join(last, "qid").select("qid", (F.col("last") + F.col("pass_no")).alias("pass_no"), "letter"))


def passes(doc_margin: Column | str, n_docs: Column | str, page_margin: Column | str, top_pages: Column | str, base: int = 1, hard: int = 3, vote_margin: float = 0.08, long_doc: int = 80, gate: bool = False, easy: int = 1, easy_doc_margin: float = 0.12, easy_page_margin: float = 0.05, fast: Column | None = None) -> Column:
    """H1: number of votes, as one CASE."""
    doc_margin, n_docs, page_margin, top_pages = (F.col(x) if isinstance(x, str) else x for x in (doc_margin, n_docs, page_margin, top_pages))
    doc_margin, page_margin = F.round(doc_margin, 9), F.round(page_margin, 9)
    is_long = F.coalesce(top_pages, F.lit(0)) >= long_doc
    out = F.when(F.lit(False) if fast is None else fast, 1)
    if gate and easy < base:
        out = out.when((doc_margin >= easy_doc_margin) & (page_margin >= easy_page_margin) & ~is_long, easy)
    if base == hard:
        return out.otherwise(base)
    return out.when(n_docs < 2, F.when(is_long, hard).otherwise(base)).when(doc_margin < vote_margin, hard).when(is_long, hard).otherwise(base)


def governor(steps: DataFrame, total: int | Column, budget_seconds: float = 8.5 * 3600, warm_up: int = 25, before_seconds: float = 0.0, run: str = "run", order: tuple[str, ...] = ("ts", "event_id"), seconds: str = "seconds") -> DataFrame:
    """Adds done, elapsed, projected, trips, fast (latched) and fast_before (what the step itself runs under) to the steps of each run, in order.

    A distributed scan, so a run of any length is no one task's: steps are dealt by ranges of (run, order) and written with the number of their range; a range's
    steps are counted and summed by themselves, and the totals of the run's earlier ranges, one row a range, are added.  The latch needs no
    second scan: it holds from the first step that trips.
    """
    blocked = written(steps.repartitionByRange(run, *order).withColumn("_block", F.spark_partition_id()), scratch_path(steps.sparkSession))
    by_range = blocked.groupBy(run, "_block").agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("s"))
    earlier = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select(F.col(run).alias("_run"), F.col("_block").alias("_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_done"), F.sum("s").over(earlier).alias("_elapsed"))
    inside = Window.partitionBy(run, "_block").orderBy(*order)
    local = blocked.withColumns({"_n": F.row_number().over(inside), "_s": F.sum(seconds).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    timed = local.join(offsets, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_block") == F.col("_range"))).withColumns({"done": F.col("_done") + F.col("_n"), "elapsed": F.when(F.col("_elapsed").isNull(), F.col("_s")).otherwise(F.col("_elapsed") + F.coalesce("_s", F.lit(0)))})
    total = F.lit(total) if isinstance(total, int) else total
    projected = timed.withColumn("projected", before_seconds + F.col("elapsed") + F.col("elapsed") / F.col("done") * F.greatest(total - F.col("done"), F.lit(0)))
    trips = projected.withColumn("trips", (F.col("done") >= warm_up) & (F.round("projected", 6) > budget_seconds)).drop("_block", "_range", "_run", "_n", "_s", "_done", "_elapsed")
    first = trips.where("trips").groupBy(F.col(run).alias("_run")).agg(F.min("done").alias("_first"))
    latched = lambda holds: F.coalesce(holds, F.lit(False))
    return trips.join(first, F.col(run).eqNullSafe(F.col("_run")), "left").withColumns({"fast": latched(F.col("done") >= F.col("_first")), "fast_before": latched(F.col("done") > F.col("_first"))}).drop("_first", "_run")
