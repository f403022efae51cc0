"""Whole configurations over the stand-in views: documents' lines as pages, benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.plans import config, models, planner
from pagemill.plans.registry import query, table, text_pages
from pagemill.sources import page_files
from pagemill.sources.scratch import scratch_path
from pagemill.sources.vectors import VectorStore


def questions(spark, d):
    """Benchmark items with options made from their own text."""
    text = F.col("text")
    options = F.create_map(*[x for k, v in zip("ABCDEF", (F.left(text, F.lit(30)), F.right(text, F.lit(30)), F.reverse(text), F.lit("так"), F.lit("ні"), F.substring(text, 10, 30))) for x in (F.lit(k), v)])
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), text.alias("question"), options.alias("options"))


def run(spark, d, name: str, **overrides):
    pages = text_pages(spark, d).select("doc_id", "page_num", "text")
    return planner.build(config.resolve(name, overrides or None), questions(spark, d), pages).predictions


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), b AS (SELECT text FROM benchmark),
n AS (SELECT 'first half' AS demand, 1 AS step, count(*) AS n_rows, count(DISTINCT text) AS n_encoded FROM p WHERE doc_id % 2 = 0
UNION ALL SELECT 'all pages', 2, count(*), (SELECT count(DISTINCT text) FROM p) - (SELECT count(DISTINCT text) FROM p WHERE doc_id % 2 = 0) FROM p
UNION ALL SELECT 'all again', 3, count(*), 0 FROM p
UNION ALL SELECT 'questions', 4, count(*), (SELECT count(*) FROM (SELECT DISTINCT coalesce(text, '') FROM b EXCEPT SELECT coalesce(text, '') FROM p)) FROM b)
SELECT * FROM n""")
def kept_vectors(spark, d):
    """What a store encodes as demands come: pages of half the documents, of all, of all again, and questions; nothing twice."""
    pages = text_pages(spark, d).select("doc_id", "page_num", "text")
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).cast("long").alias("page_num"), "text")
    store, out = VectorStore(spark, scratch_path(spark)), None
    for step, (name, rows) in enumerate((("first half", pages.where("doc_id % 2 = 0")), ("all pages", pages), ("all again", pages), ("questions", asks)), 1):
        found = store.embed(rows, models.hashed_encoder).where("emb is not null").agg(F.lit(name).alias("demand"), F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_rows"), F.lit(store.encoded).alias("n_encoded"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH p AS (SELECT coalesce(lang, 'none') AS lang, unnest(string_split(text, chr(10))) AS page FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS n_pages, count(*) FILTER (WHERE page = '') AS n_empty, sum(length(page))::BIGINT AS n_chars, max(length(page)) AS longest FROM p GROUP BY lang""")
def page_file_scan(spark, d):
    """Documents written as text files in a folder for each language, and read back as pages (lines) by the page-file source."""
    docs, folder = table(spark, d, "documents"), scratch_path(spark)
    docs.where("text is not null").select("text", F.coalesce("lang", F.lit("none")).alias("lang")).write.partitionBy("lang").text(folder)
    pages, _ = page_files.without_events(page_files.read_pages(spark, folder, page_files.line_pages, "*.txt"))
    size = F.length("text")
    return pages.groupBy(F.regexp_replace("domain", "^lang=", "").alias("lang")).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(size == 0).alias("n_empty"), F.sum(size).alias("n_chars"), F.max(size).alias("longest"))


@query(None)
def run_v7_baseline(spark, d):
    return run(spark, d, "v7_baseline")


@query(None)
def run_v9_regression(spark, d):
    return run(spark, d, "v9_regression")


@query(None)
def run_hybrid_rrf(spark, d):
    return run(spark, d, "candidate_hybrid_rrf_v1")


@query(None)
def run_structure_guard(spark, d):
    return run(spark, d, "candidate_structure_chunks_v2_doc_guard")


@query(None)
def run_page_summary(spark, d):
    return run(spark, d, "candidate_page_summary_selector_v1")
