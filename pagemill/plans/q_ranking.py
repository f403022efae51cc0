"""Queries of retrieval, document ranking, reranking, context and page choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import answer as an
from pagemill.operators import locate, metrics, postings, rank, retrieve
from pagemill.plans.registry import DOCS, VEC, dense_sql, query, table, tokens_sql, vec_meta, vec_pages, vec_queries
from pagemill.sources.scratch import scratch_path

R = lambda c, n=6: F.round(c, n).alias(c)


def dense(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieve.dense_topk(vec_pages(spark, d), vec_queries(spark, d), k, exclude_self=True)


@query(f"WITH {dense_sql()} SELECT qid, doc_id, page_num, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, d):
    return dense(spark, d).select("qid", "doc_id", "page_num", R("score"), "rank")


_METRICS = """count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1.0 / log2(rank + 1), 0)), 6) AS ndcg, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS found, round(coalesce(avg(rank), 0), 6) AS mean_rank_found, round(quantile_cont(rank, 0.5), 6) AS median_rank_found, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10"""
_NAMES = ["mrr", "ndcg", "found", "mean_rank_found", "median_rank_found", "recall_1", "recall_3", "recall_5", "recall_10"]


def _ranked(spark, d) -> DataFrame:
    pages = dense(spark, d)
    want = vec_queries(spark, d).select("qid", F.col("truth").alias("doc_id"))
    stages = [("dense_doc", rank.doc_ranking(pages)), ("dense_page", pages), ("guarded_doc", rank.guarded_ranking(pages))]
    out = [metrics.rank_of(r, want, ["doc_id"]).select(F.lit(s).alias("stage"), F.concat(F.lit("label_"), F.col("doc_id").cast("string")).alias("domain"), "rank", "qid") for s, r in stages]
    return out[0].unionByName(out[1]).unionByName(out[2])


_GUARD = """guard_pages AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS n FROM dense),
guarded AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first_rank) AS rank FROM (SELECT qid, doc_id, sum(CASE WHEN n = 1 THEN score ELSE 0.35::DOUBLE * score END) AS score, min(rank) AS first_rank FROM guard_pages WHERE n <= 2 GROUP BY qid, doc_id))"""
_RANKED = f"""{DOCS}, {_GUARD},
ranked AS (SELECT 'dense_doc' AS stage, q.qid, 'label_' || q.truth::VARCHAR AS domain, min(r.rank) AS rank FROM q LEFT JOIN docs r ON r.qid = q.qid AND r.doc_id = q.truth GROUP BY q.qid, q.truth
UNION ALL SELECT 'dense_page', q.qid, 'label_' || q.truth::VARCHAR, min(r.rank) FROM q LEFT JOIN dense r ON r.qid = q.qid AND r.doc_id = q.truth GROUP BY q.qid, q.truth
UNION ALL SELECT 'guarded_doc', q.qid, 'label_' || q.truth::VARCHAR, min(r.rank) FROM q LEFT JOIN guarded r ON r.qid = q.qid AND r.doc_id = q.truth GROUP BY q.qid, q.truth)"""


@query(f"WITH {dense_sql()}, {_RANKED} SELECT CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain, {_METRICS} FROM ranked WHERE stage = 'dense_doc' GROUP BY GROUPING SETS ((), (domain))")
def dense_topk_eval(spark, d):
    pages = dense(spark, d)
    want = vec_queries(spark, d).select("qid", F.col("truth").alias("doc_id"))
    ranked = metrics.rank_of(rank.doc_ranking(pages), want, ["doc_id"]).select(F.lit("dense_doc").alias("stage"), F.concat(F.lit("label_"), F.col("doc_id").cast("string")).alias("domain"), "rank")
    return metrics.ir_report(ranked).select("domain", "n", *map(R, _NAMES))


@query(f"WITH {dense_sql()}, {_RANKED} SELECT stage, CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain, {_METRICS} FROM ranked GROUP BY GROUPING SETS ((stage), (stage, domain))")
def ir_metrics(spark, d):
    return metrics.ir_report(_ranked(spark, d)).select("stage", "domain", "n", *map(R, _NAMES))


@query(f"WITH {dense_sql()}, {_RANKED}, report AS (SELECT stage, CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain, {_METRICS} FROM ranked GROUP BY GROUPING SETS ((stage), (stage, domain))) SELECT a.domain, a.mrr AS mrr_before, b.mrr AS mrr_after, round(b.mrr - a.mrr, 6) AS mrr_lift, round(b.recall_1 - a.recall_1, 6) AS recall_lift FROM report a JOIN report b USING (domain) WHERE a.stage = 'dense_page' AND b.stage = 'guarded_doc'")
def rerank_lift(spark, d):
    from pagemill.operators.analyses import stage_lift

    report = metrics.ir_report(_ranked(spark, d)).select("stage", "domain", R("mrr"), R("recall_1"))
    return stage_lift(report, "dense_page", "guarded_doc").select("domain", "mrr_before", "mrr_after", R("mrr_lift"), R("recall_lift"))


# -- sparse and hybrid: documents as one page each, every benchmark item a query


def text_docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page_num"), "text")


def text_queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", F.col("text").alias("question"))


def bm25_sql(k: int) -> str:
    return f"""toks AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents),
size AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), size),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
qt AS (SELECT item_id AS qid, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id, unnest({tokens_sql("text")}) AS term FROM benchmark) GROUP BY item_id, term),
parts AS (SELECT qid, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN toks ON toks.doc_id = tf.doc_id CROSS JOIN size GROUP BY qid, tf.doc_id),
scores AS (SELECT b.item_id AS qid, d.doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN parts p ON p.qid = b.item_id AND p.doc_id = d.doc_id),
bm AS (SELECT * FROM (SELECT qid, doc_id, 1::BIGINT AS page_num, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= {k})"""


@query(f"WITH {bm25_sql(10)} SELECT qid, doc_id, page_num, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return retrieve.bm25_topk(text_docs(spark, d), text_queries(spark, d), 10).select("qid", "doc_id", "page_num", R("score"), "rank")


@query(f"WITH {bm25_sql(10)} SELECT qid, doc_id, page_num, round(score, 6) AS score, rank FROM bm")
def bm25_index_topk(spark, d):
    """The same ranking from a written index whose lists are read as far as their bounds ask for."""
    index = postings.build_index(text_docs(spark, d), scratch_path(spark))
    return postings.search(index, text_queries(spark, d), 10).select("qid", "doc_id", "page_num", R("score"), "rank")


# the dense side of the fusion: pages of the query's neighbours by a second vector space (the vector reversed)
_REV = """rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, page_num) AS rank FROM (SELECT q.qid, v.doc_id, v.page_num, list_dot_product(list_transform(q.emb, lambda x: abs(x)), list_transform(v.emb, lambda x: abs(x))) AS score FROM q JOIN v ON v.page_num <> q.qid)) WHERE rank <= 40)"""


def reverse(spark, d, k: int = 40) -> DataFrame:
    up = lambda df: df.withColumn("emb", F.transform("emb", lambda x: F.abs(x)))
    return retrieve.dense_topk(up(vec_pages(spark, d)), up(vec_queries(spark, d)), k, exclude_self=True)


_RRF = """parts2 AS (SELECT qid, doc_id, page_num, 1.0::DOUBLE / (60 + rank) AS part, rank AS seen FROM dense UNION ALL SELECT qid, doc_id, page_num, 1.0::DOUBLE / (60 + rank), 1000000000 + rank FROM rev),
fused AS (SELECT qid, doc_id, page_num, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM (SELECT qid, doc_id, page_num, sum(part) AS score, min(seen) AS seen FROM parts2 GROUP BY qid, doc_id, page_num))"""


@query(f"WITH {dense_sql()}, {_REV}, {_RRF} SELECT qid, doc_id, page_num, round(score, 9) AS score, rank FROM fused")
def rrf_fusion(spark, d):
    return retrieve.rrf([dense(spark, d), reverse(spark, d)]).select("qid", "doc_id", "page_num", R("score", 9), "rank")


@query(f"WITH {dense_sql()}, {_REV}, {_RRF} SELECT qid, doc_id, page_num, round(score, 9) AS score, rank FROM fused WHERE rank <= 20")
def hybrid_topk(spark, d):
    return retrieve.hybrid(dense(spark, d), reverse(spark, d), 20).select("qid", "doc_id", "page_num", R("score", 9), "rank")


# -- structure chunks: three chunks per page, its vector and two rotations of it


def chunk_vectors(spark, d) -> DataFrame:
    rot = lambda c, n: F.concat(F.slice(c, n + 1, 1000), F.slice(c, 1, n))
    return vec_pages(spark, d).select("doc_id", "page_num", F.explode(F.array(F.col("emb"), rot("emb", 8), rot("emb", 16))).alias("emb"))


_CHUNKS = "chunks AS (SELECT doc_id, page_num, unnest([emb, list_concat(emb[9:], emb[:8]), list_concat(emb[17:], emb[:16])]) AS emb FROM v)"


def _chunk_sql(gate: str) -> str:
    return f"""WITH {dense_sql(60)}, {DOCS}, {_CHUNKS},
wanted AS (SELECT qid, doc_id FROM docs WHERE rank <= 3 {gate}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, page_num) AS n FROM (SELECT w.qid, c.doc_id, c.page_num, max(list_dot_product(q.emb, c.emb)) AS score FROM wanted w JOIN q ON q.qid = w.qid JOIN chunks c ON c.doc_id = w.doc_id GROUP BY w.qid, c.doc_id, c.page_num)) WHERE n <= 6),
merged AS (SELECT qid, doc_id, page_num, max(score) AS score FROM (SELECT qid, doc_id, page_num, score FROM dense UNION ALL SELECT qid, doc_id, page_num, score FROM best) GROUP BY qid, doc_id, page_num)
SELECT qid, doc_id, page_num, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, page_num) AS rank FROM merged) WHERE rank <= 20"""


@query(_chunk_sql(""))
def structure_chunk_retrieval(spark, d):
    return retrieve.chunk_retrieval(dense(spark, d, 60), chunk_vectors(spark, d), vec_queries(spark, d), 20).select("qid", "doc_id", "page_num", R("score"), "rank")


@query(_chunk_sql("AND qid IN (SELECT d1.qid FROM docs d1 JOIN meta m ON m.doc_id = d1.doc_id WHERE d1.rank = 1 AND m.n_pages >= 50)"))
def structure_chunk_short_doc_gate(spark, d):
    return retrieve.chunk_retrieval(dense(spark, d, 60), chunk_vectors(spark, d), vec_queries(spark, d), 20, doc_meta=vec_meta(spark, d), min_top_doc_pages=50).select("qid", "doc_id", "page_num", R("score"), "rank")


@query(f"WITH {VEC} SELECT doc_id, list(page_num ORDER BY page_num) AS pages, count(*) AS n_pages FROM v GROUP BY doc_id")
def doc_pages(spark, d):
    return retrieve.doc_pages(vec_pages(spark, d))


# -- document ranking


@query(f"WITH {dense_sql()}, {DOCS} SELECT qid, doc_id, round(score, 6) AS score, rank FROM docs")
def doc_ranking(spark, d):
    return rank.doc_ranking(dense(spark, d)).select("qid", "doc_id", R("score"), "rank")


@query(f"WITH {dense_sql()}, {_GUARD} SELECT qid, doc_id, round(score, 6) AS score, rank FROM guarded")
def doc_guard(spark, d):
    return rank.guarded_ranking(dense(spark, d)).select("qid", "doc_id", R("score"), "rank")


@query(f"WITH {dense_sql()}, {DOCS} SELECT qid, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin FROM docs GROUP BY qid")
def doc_margin(spark, d):
    return rank.margins(rank.doc_ranking(dense(spark, d))).select("qid", R("margin"))


_LOCK = """flags AS (SELECT t.qid, t.top_doc, t.margin, m.n_pages, m.n_pages >= 45 AND t.margin > 0.01 AS locked FROM (SELECT qid, arg_min(doc_id, rank) AS top_doc, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS margin FROM dense GROUP BY qid) t JOIN meta m ON m.doc_id = t.top_doc)"""


def _flags(spark, d, pages):
    return rank.lock_flags(pages, vec_meta(spark, d), 45, 0.01)


@query(f"WITH {dense_sql()}, {_LOCK} SELECT f.qid, d.doc_id, d.page_num, round(d.score, 6) AS score, row_number() OVER (PARTITION BY f.qid ORDER BY f.locked AND d.doc_id <> f.top_doc, d.rank) AS rank, f.locked FROM dense d JOIN flags f USING (qid)")
def doc_lock(spark, d):
    pages = dense(spark, d)
    flags = _flags(spark, d, pages)
    return rank.locked_order(pages, flags).join(flags.select("qid", "locked"), "qid").select("qid", "doc_id", "page_num", R("score"), "rank", "locked")


@query(f"""WITH {dense_sql()}, {_LOCK},
part AS (SELECT f.qid, v.doc_id, v.page_num, list_dot_product(q.emb, v.emb) AS score, 0 AS part, row_number() OVER (PARTITION BY f.qid ORDER BY round(list_dot_product(q.emb, v.emb), 9) DESC, v.page_num) AS rank FROM flags f JOIN q ON q.qid = f.qid JOIN v ON v.doc_id = f.top_doc WHERE f.locked
UNION ALL SELECT d.qid, d.doc_id, d.page_num, d.score, 1, d.rank FROM dense d JOIN flags f USING (qid) WHERE NOT f.locked OR d.doc_id <> f.top_doc)
SELECT qid, doc_id, page_num, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY part, rank) AS rank FROM part""")
def doc_lock_exhaustive(spark, d):
    pages = dense(spark, d)
    return rank.exhaustive_lock(pages, _flags(spark, d, pages), vec_pages(spark, d), vec_queries(spark, d)).select("qid", "doc_id", "page_num", R("score"), "rank")


@query(f"WITH {dense_sql()}, {DOCS}, {_GUARD} SELECT a.qid, a.doc_id AS plain_top, b.doc_id AS guarded_top, a.doc_id <> b.doc_id AS changed FROM docs a JOIN guarded b ON a.qid = b.qid AND a.rank = 1 AND b.rank = 1")
def doc_guard_changed(spark, d):
    return rank.guard_changed(dense(spark, d))


@query(f"""WITH {dense_sql()}, top AS (SELECT qid, arg_min(doc_id, rank) AS top FROM dense GROUP BY qid),
s AS (SELECT d.qid, count(*) AS n, sum(CASE WHEN rank <= 3 AND doc_id = top THEN 1 ELSE 0 END) AS same, max(CASE WHEN rank = 1 THEN score END) AS lead, arg_min(score, rank) FILTER (WHERE doc_id <> top) AS other FROM dense d JOIN top USING (qid) GROUP BY d.qid)
SELECT qid, n <= 1 OR other IS NULL OR (same >= 3 AND round(lead - other, 9) >= 0.035) AS skip FROM s""")
def doc_rerank_skip(spark, d):
    return rank.skip_flags(dense(spark, d))


# -- text-bound steps over the BM25 ranking


def _bm_pages(spark, d) -> DataFrame:
    return retrieve.bm25_topk(text_docs(spark, d), text_queries(spark, d), 10)


_STRIPPED = "trim(dd.text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"WITH {bm25_sql(10)} SELECT qid, doc_id, round(score, 6) AS score, rank, md5(CASE WHEN {_STRIPPED} = '' THEN '[No text]' ELSE '[Page 1]' || chr(10) || left({_STRIPPED}, 2000) END) AS preview FROM bm JOIN documents dd USING (doc_id) WHERE rank <= 6")
def doc_preview(spark, d):
    return rank.doc_previews(_bm_pages(spark, d), text_docs(spark, d)).select("qid", "doc_id", R("score"), "rank", F.md5("preview").alias("preview"))


_RERANKED = f"""reranked AS (SELECT qid, doc_id, page_num, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, before) AS rank FROM (SELECT bm.qid, bm.doc_id, bm.page_num, bm.rank AS before, len(list_intersect(qq.w, {tokens_sql("dd.text")}))::DOUBLE / len(qq.w) AS score FROM bm JOIN documents dd USING (doc_id) JOIN (SELECT item_id AS qid, list_distinct({tokens_sql("text")}) AS w FROM benchmark) qq USING (qid)))"""


@query(f"WITH {bm25_sql(10)}, {_RERANKED} SELECT qid, doc_id, page_num, round(score, 6) AS score, rank FROM reranked")
def rerank_pages(spark, d):
    return rank.rerank_pages(_bm_pages(spark, d), text_queries(spark, d), text_docs(spark, d)).select("qid", "doc_id", "page_num", R("score"), "rank")


@query(f"WITH {bm25_sql(10)} SELECT qid, md5(string_agg('[Сторінка 1]' || chr(10) || left({_STRIPPED}, 3500), chr(10) || chr(10) ORDER BY rank)) AS context FROM bm JOIN documents dd USING (doc_id) WHERE rank <= 4 GROUP BY qid")
def build_context(spark, d):
    return an.build_context(_bm_pages(spark, d), text_docs(spark, d)).select("qid", F.md5("context").alias("context"))


@query(f"""WITH {bm25_sql(10)}, shown AS (SELECT bm.qid, bm.doc_id, bm.rank AS before, CASE WHEN {_STRIPPED} = '' THEN '[No text]' ELSE '[Page 1]' || chr(10) || left({_STRIPPED}, 2000) END AS preview FROM bm JOIN documents dd USING (doc_id) WHERE bm.rank <= 6),
scored AS (SELECT s.qid, s.doc_id, s.before, len(list_intersect(qq.w, {tokens_sql("s.preview")}))::DOUBLE / len(qq.w) AS score FROM shown s JOIN (SELECT item_id AS qid, list_distinct({tokens_sql("text")}) AS w FROM benchmark) qq USING (qid))
SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, before) AS rank, false AS skipped FROM scored""")
def rerank_docs_unless_sure(spark, d):
    return rank.rerank_docs_unless_sure(_bm_pages(spark, d), text_docs(spark, d), text_queries(spark, d)).select("qid", "doc_id", R("score"), "rank", "skipped")


# -- page choice; the answer-augmented query is the query vector rotated by one place
_AUG = "aug AS (SELECT qid, truth, list_concat(emb[2:], emb[:1]) AS emb FROM q), tops AS (SELECT qid, arg_min(doc_id, rank) AS doc_id FROM dense GROUP BY qid)"


def augmented(spark, d) -> DataFrame:
    return vec_queries(spark, d).select("qid", F.concat(F.slice("emb", 2, 1000), F.slice("emb", 1, 1)).alias("emb"))


def _tops(pages: DataFrame) -> DataFrame:
    return rank.doc_ranking(pages).where("rank = 1").select("qid", "doc_id")


@query(f"WITH {dense_sql()}, {_AUG} SELECT qid, doc_id, page_num, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM dense JOIN tops USING (qid, doc_id)) WHERE n = 1")
def page_first(spark, d):
    pages = dense(spark, d)
    return locate.first_page(pages, _tops(pages)).select("qid", "doc_id", "page_num", R("score"))


@query(f"WITH {dense_sql()}, {_AUG} SELECT qid, doc_id, page_num, round(s, 6) AS score FROM (SELECT d.*, list_dot_product(a.emb, v.emb) AS s, row_number() OVER (PARTITION BY d.qid ORDER BY round(list_dot_product(a.emb, v.emb), 9) DESC, d.rank) AS n FROM dense d JOIN tops USING (qid, doc_id) JOIN aug a ON a.qid = d.qid JOIN v ON v.page_num = d.page_num) WHERE n = 1")
def page_same_doc(spark, d):
    pages = dense(spark, d)
    return locate.same_doc(pages, _tops(pages), augmented(spark, d), vec_pages(spark, d)).select("qid", "doc_id", "page_num", R("score"))


@query(f"""WITH {dense_sql()}, {_AUG},
short AS (SELECT * FROM (SELECT t.qid, t.doc_id, v.page_num, list_dot_product(q.emb, list_transform(v.emb, lambda x: abs(x))) AS s, row_number() OVER (PARTITION BY t.qid ORDER BY round(list_dot_product(q.emb, list_transform(v.emb, lambda x: abs(x))), 9) DESC, v.page_num) AS place FROM tops t JOIN q ON q.qid = t.qid JOIN v ON v.doc_id = t.doc_id) WHERE place <= 3)
SELECT qid, doc_id, page_num, round(score, 6) AS score, round(page_margin, 6) AS page_margin, shortlist FROM (SELECT s.qid, s.doc_id, s.page_num, list_dot_product(a.emb, v.emb) AS score, max(CASE WHEN place = 1 THEN s END) OVER (PARTITION BY s.qid) - max(CASE WHEN place = 2 THEN s END) OVER (PARTITION BY s.qid) AS page_margin, count(*) OVER (PARTITION BY s.qid) AS shortlist, row_number() OVER (PARTITION BY s.qid ORDER BY round(list_dot_product(a.emb, v.emb), 9) DESC, place) AS n FROM short s JOIN aug a ON a.qid = s.qid JOIN v ON v.page_num = s.page_num) WHERE n = 1""")
def page_summary_select(spark, d):
    summaries = vec_pages(spark, d).withColumn("emb", F.transform("emb", lambda x: F.abs(x)))
    return locate.summary_then_answer(_tops(dense(spark, d)), vec_queries(spark, d), augmented(spark, d), summaries, vec_pages(spark, d)).select("qid", "doc_id", "page_num", R("score"), R("page_margin"), "shortlist")


_PAGE_SCORES = "ps AS (SELECT t.qid, t.doc_id, v.page_num, list_dot_product(a.emb, v.emb) AS score FROM tops t JOIN aug a ON a.qid = t.qid JOIN v ON v.doc_id = t.doc_id)"


@query(f"""WITH {dense_sql()}, {_AUG}, {_PAGE_SCORES},
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, page_num) AS place FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM ps) WHERE round(top - score, 9) <= 0.02),
short AS (SELECT n.*, coalesce(d.rank, 1000000) AS seen FROM near n LEFT JOIN dense d ON d.qid = n.qid AND d.page_num = n.page_num WHERE place <= 4)
SELECT qid, doc_id, page_num, round(score, 6) AS score, round(page_margin, 6) AS page_margin, shortlist FROM (SELECT *, max(CASE WHEN place = 1 THEN score END) OVER (PARTITION BY qid) - max(CASE WHEN place = 2 THEN score END) OVER (PARTITION BY qid) AS page_margin, count(*) OVER (PARTITION BY qid) AS shortlist, row_number() OVER (PARTITION BY qid ORDER BY seen, round(score, 9) DESC, page_num) AS k FROM short) WHERE k = 1""")
def page_threshold(spark, d):
    pages = dense(spark, d)
    return locate.threshold(locate.page_scores(_tops(pages), augmented(spark, d), vec_pages(spark, d)), pages).select("qid", "doc_id", "page_num", R("score"), R("page_margin"), "shortlist")


@query(f"WITH {dense_sql()}, {_AUG}, {_PAGE_SCORES}, top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, page_num) AS rank FROM ps) WHERE rank <= 3) SELECT qid, doc_id, page_num, round(score, 6) AS score, rank, round(m, 6) AS page_margin, coalesce(round(m, 9) < 0.03, false) AS stage2 FROM (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY qid) - max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY qid) AS m FROM top3)")
def page_locked_topk(spark, d):
    scores = locate.page_scores(_tops(dense(spark, d)), augmented(spark, d), vec_pages(spark, d))
    return locate.locked_top_k(scores).select("qid", "doc_id", "page_num", R("score"), "rank", R("page_margin"), "stage2")


@query(f"WITH {dense_sql()}, {_AUG}, {_CHUNKS} SELECT t.qid, t.doc_id, c.page_num, round(max(list_dot_product(a.emb, c.emb)), 6) AS score FROM tops t JOIN aug a ON a.qid = t.qid JOIN chunks c ON c.doc_id = t.doc_id GROUP BY t.qid, t.doc_id, c.page_num")
def page_max_segment(spark, d):
    return locate.page_scores(_tops(dense(spark, d)), augmented(spark, d), vec_pages(spark, d), chunk_vectors(spark, d)).select("qid", "doc_id", "page_num", R("score"))


@query(f"""WITH {dense_sql()}, hits AS (SELECT d.qid, d.rank, greatest(0.0::DOUBLE, 1 - abs(d.page_num - d.qid)::DOUBLE / m.n_pages) AS near FROM dense d JOIN q ON q.qid = d.qid AND q.truth = d.doc_id JOIN meta m ON m.doc_id = d.doc_id),
best AS (SELECT q.qid, coalesce(max(CASE WHEN rank <= 1 THEN near END), 0) AS p1, coalesce(max(CASE WHEN rank <= 3 THEN near END), 0) AS p3, coalesce(max(CASE WHEN rank <= 5 THEN near END), 0) AS p5, coalesce(max(CASE WHEN rank <= 10 THEN near END), 0) AS p10 FROM q LEFT JOIN hits h ON h.qid = q.qid GROUP BY q.qid)
SELECT round(avg(p1), 6) AS proximity_1, round(avg(p3), 6) AS proximity_3, round(avg(p5), 6) AS proximity_5, round(avg(p10), 6) AS proximity_10 FROM best""")
def page_proximity_at_k(spark, d):
    want = vec_queries(spark, d).select("qid", F.col("truth").alias("doc_id"), F.col("qid").alias("true_page")).join(vec_meta(spark, d), "doc_id")
    return metrics.proximity_at(dense(spark, d), want).select(*[R(f"proximity_{k}") for k in metrics.CUTS])


@query(f"""WITH {dense_sql()}, {DOCS}, m AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS dm, count(*) AS n, arg_min(doc_id, rank) AS top FROM docs GROUP BY qid),
p AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS pm FROM dense GROUP BY qid)
SELECT m.qid, CASE WHEN n < 2 THEN CASE WHEN n_pages >= 55 THEN 3 ELSE 1 END WHEN round(dm, 9) < 0.08 THEN 3 WHEN n_pages >= 55 THEN 3 ELSE 1 END AS passes, CASE WHEN round(dm, 9) >= 0.12 AND round(pm, 9) >= 0.005 AND n_pages < 55 THEN 1 ELSE 3 END AS gated FROM m JOIN p USING (qid) JOIN meta ON meta.doc_id = m.top""")
def choose_passes(spark, d):
    pages = dense(spark, d)
    docs = rank.doc_ranking(pages)
    m = docs.groupBy("qid").agg(rank.top_margin().alias("dm"), F.count(F.lit(1)).alias("n"), F.max_by("doc_id", -F.col("rank")).alias("doc_id"))
    joined = m.join(rank.margins(pages).withColumnRenamed("margin", "pm"), "qid").join(vec_meta(spark, d), "doc_id")
    plain = an.passes("dm", "n", "pm", "n_pages", 1, 3, long_doc=55)
    gated = an.passes("dm", "n", "pm", "n_pages", 3, 3, long_doc=55, gate=True, easy=1, easy_page_margin=0.005)
    return joined.select("qid", plain.alias("passes"), gated.alias("gated"))




@query(f"WITH {VEC} SELECT qid, round(1 / (1 + exp(emb[1] - emb[2])), 9) AS p_yes FROM q")
def yes_probability(spark, d):
    return vec_queries(spark, d).select("qid", F.round(rank.yes_probability(F.element_at("emb", 1), F.element_at("emb", 2)), 9).alias("p_yes"))


@query(f"""WITH {dense_sql()}, {_LOCK}, {DOCS}, {_GUARD}, top AS (SELECT qid, arg_min(doc_id, rank) AS top FROM dense GROUP BY qid),
sk AS (SELECT d.qid, count(*) AS n, sum(CASE WHEN rank <= 3 AND doc_id = top THEN 1 ELSE 0 END) AS same, max(CASE WHEN rank = 1 THEN score END) AS lead, arg_min(score, rank) FILTER (WHERE doc_id <> top) AS other FROM dense d JOIN top USING (qid) GROUP BY d.qid),
f AS (SELECT flags.qid, locked, n <= 1 OR other IS NULL OR (same >= 3 AND round(lead - other, 9) >= 0.035) AS skip, (SELECT a.doc_id <> b.doc_id FROM docs a JOIN guarded b ON a.qid = b.qid WHERE a.qid = flags.qid AND a.rank = 1 AND b.rank = 1) AS changed FROM flags JOIN sk USING (qid))
SELECT count(*) AS questions, count(*) FILTER (WHERE locked) AS locked, count(*) FILTER (WHERE skip) AS skip, count(*) FILTER (WHERE changed) AS changed FROM f""")
def diagnostics(spark, d):
    pages = dense(spark, d)
    flags = _flags(spark, d, pages).select("qid", "locked").join(rank.skip_flags(pages), "qid").join(rank.guard_changed(pages).select("qid", "changed"), "qid")
    return metrics.counters(flags, "locked", "skip", "changed")
