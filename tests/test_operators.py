"""Hand-worked expectations and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import analyses, answer, compare, locate, metrics, rank, retrieve, splits

RANKING = "qid int, doc_id string, page_num int, score double, rank int"


def ranking(spark, *rows):
    return spark.createDataFrame([(1, d, p, float(s), i) for i, (d, p, s) in enumerate(rows, 1)], RANKING)


def test_rrf(spark):
    a, b = ranking(spark, ("a", 1, 1), ("b", 1, 0.5)), ranking(spark, ("b", 1, 1), ("c", 1, 0.5))
    got = [(r.doc_id, round(r.score, 6)) for r in retrieve.rrf([a, b]).orderBy("rank").collect()]
    assert got == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]
    swapped = {r.doc_id: round(r.score, 12) for r in retrieve.rrf([b, a]).collect()}
    assert swapped == {r.doc_id: round(r.score, 12) for r in retrieve.rrf([a, b]).collect()}


def test_guard(spark):
    got = rank.guarded_ranking(ranking(spark, ("A", 1, 0.8), ("B", 1, 0.7), ("B", 2, 0.6))).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [("B", 0.91), ("A", 0.8)]


def test_margin(spark):
    assert rank.margins(ranking(spark, ("a", 1, 0.9), ("b", 1, 0.8))).first().margin == pytest.approx(0.1)
    assert rank.margins(ranking(spark, ("a", 1, 0.9))).first().margin is None


def test_lock(spark):
    pages = ranking(spark, ("a", 1, 0.75), ("b", 1, 0.5))
    meta = spark.createDataFrame([("a", 26), ("b", 3)], "doc_id string, n_pages int")
    assert not rank.lock_flags(pages, meta, 27).first().locked
    assert not rank.lock_flags(pages, meta, 0, 0.25).first().locked
    assert rank.lock_flags(pages, meta, 26, 0.2).first().locked


@pytest.mark.parametrize(("rows", "skip"), [([("A", 1, 0.9), ("A", 2, 0.88), ("A", 3, 0.85), ("B", 1, 0.8)], True), ([("A", 1, 0.9), ("A", 2, 0.88), ("B", 1, 0.5)], False), ([("A", 1, 0.9), ("A", 2, 0.8)], True)])
def test_skip(spark, rows, skip):
    assert rank.skip_flags(ranking(spark, *rows)).first().skip is skip


@pytest.mark.parametrize(("letters", "winner", "share"), [("BCC", "C", 0.667), ("BCD", "B", 0.333), ("CBBC", "C", 0.5)])
def test_votes(spark, letters, winner, share):
    votes = spark.createDataFrame([(1, i, x) for i, x in enumerate(letters)], "qid int, pass_no int, letter string")
    r = answer.majority(votes).first()
    assert (r.letter, round(r.confidence, 3)) == (winner, share)


@pytest.mark.parametrize(("margin", "docs", "pages", "want"), [(0.05, 2, 10, 3), (0.15, 2, 10, 1), (0.15, 2, 80, 3), (None, 1, 12, 1)])
def test_passes(spark, margin, docs, pages, want):
    df = spark.createDataFrame([(margin, docs, 0.5, pages)], "m double, d int, p double, n int")
    assert df.select(answer.passes("m", "d", "p", "n", 1, 3).alias("x")).first().x == want


def test_governor_latches(spark):
    steps = spark.createDataFrame([("r", i, i, 120.0) for i in range(1, 41)], "run string, ts int, event_id int, seconds double")
    out = answer.governor(steps, 461).orderBy("event_id").collect()
    assert [r.done for r in out if r.fast][0] == 25
    assert all(r.fast for r in out[24:])


def test_threshold(spark):
    scores = spark.createDataFrame([(1, "d", p, s) for p, s in ((1, 0.9), (2, 0.89), (3, 0.885), (4, 0.8))], "qid int, doc_id string, page_num int, score double")
    r = locate.threshold(scores, ranking(spark, ("d", 3, 1), ("d", 1, 0.5))).first()
    assert (r.page_num, r.shortlist, round(r.page_margin, 6)) == (3, 3, 0.01)


def test_scores(spark):
    truth = spark.createDataFrame([("1", "d", "10", "A", "x", "3")], "Question_ID string, Domain string, N_Pages string, Correct_Answer string, Doc_ID string, Page_Num string")
    right = spark.createDataFrame([("1", "A", "x", "5")], "Question_ID string, Correct_Answer string, Doc_ID string, Page_Num string")
    wrong = spark.createDataFrame([("1", "A", "y", "3")], right.schema)
    r = metrics.score_questions(truth, right).first()
    assert (round(r.page_proximity, 6), round(r.score, 6)) == (0.8, 0.95)
    assert metrics.score_questions(truth, wrong).first().score == 0.5
    assert metrics.evaluate(metrics.score_questions(truth.limit(0), right)).where("scope = 'all'").first().composite == 0


def test_rank_metrics(spark):
    df = spark.createDataFrame([(1,), (3,), (None,), (2,)], "rank int")
    counted = lambda df: df.groupBy("rank").agg(F.count(F.lit(1)).alias("w"))
    r = metrics.rank_metrics(counted(df)).first()
    assert [round(x, 6) for x in (r.mrr, r.ndcg, r.found, r.mean_rank_found, r.median_rank_found, r.recall_1, r.recall_3)] == [0.458333, 0.532732, 0.75, 2.0, 2.0, 0.25, 0.75]
    assert r.recall_1 <= r.recall_3 <= r.recall_5 <= r.recall_10
    none = metrics.rank_metrics(counted(spark.createDataFrame([(None,)], "rank int"))).first()
    assert none.mean_rank_found == 0 and none.median_rank_found is None
    assert metrics.rank_metrics(counted(df.limit(0))).first().n == 0


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantile_of_counts(spark, share):
    rng = np.random.default_rng(4)
    rows = [(k, int(x) if x < 30 else None) for k in "abc" for x in rng.geometric(0.08, {"a": 1, "b": 200, "c": 333}[k])]
    df = spark.createDataFrame([*rows, ("none", None)], "k string, x int")
    got = {r.k: r.quantile for r in metrics.quantile(df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("w")), "x", "k", share=share).collect()}
    for k in "abc":
        known = [x for key, x in rows if key == k and x is not None]
        assert got[k] == (pytest.approx(np.quantile(known, share)) if known else None)
    assert got["none"] is None


def test_reports_sort_no_data(spark):
    df = spark.createDataFrame([("s", "d", 1), ("s", "d", None), ("s", None, 4)], "stage string, domain string, rank int")
    got = {(r.domain, r.n, r.median_rank_found) for r in metrics.ir_report(df).collect()}
    assert got == {("all", 3, 2.5), ("d", 2, 1.0), (None, 1, 4.0)}
    assert "percentile" not in metrics.ir_report(df)._jdf.queryExecution().toString().lower()
    assert metrics.ir_report(df.limit(0)).collect() == []


def questions(spark, counts, domains=2):
    rows = [(str(100 * i + j), f"domain_{i % domains + 1}", str(3 + 5 * (i // 4)), f"doc{i}", str(j + 1)) for i, n in enumerate(counts) for j in range(n)]
    return spark.createDataFrame(rows, "Question_ID string, Domain string, N_Pages string, Doc_ID string, Page_Num string")


def test_split_protocol(spark):
    docs = splits.doc_records(questions(spark, [5 + i % 7 for i in range(41)]))
    sizes = {r.length_bucket: r["count"] for r in docs.groupBy("length_bucket").count().collect()}
    assert sizes == {"q1": 11, "q2": 11, "q3": 11, "q4": 8}
    out = splits.protocol(docs).collect()
    assert sum(r.role == "lockbox" for r in out) == 8
    assert all((r.fold >= 0) == (r.role == "cv") for r in out)
    assert sorted(sum(r.fold == k for r in out) for k in range(5)) == [6, 6, 7, 7, 7]
    assert sum(r.legacy == "val" for r in out) == round(33 * 0.2)


def test_balanced_choice_against_all_documents(spark):
    """The choice by classes is that of a look at every document at every step."""
    docs = [r.asDict() for r in splits.doc_records(questions(spark, [3 + i * 7 % 5 for i in range(37)], 3)).collect()]
    n, ratio = 11, 11 / 37
    want = {kind: {k: ratio * sum(d[kind] == k for d in docs) for k in {d[kind] for d in docs}} for kind in ("domain", "length_bucket")}
    off = lambda value, target: ((value - target) / max(target, 1.0)) ** 2
    picked: list = []
    while len(picked) < n:

        def cost(d):
            new = [*picked, d]
            total = splits.DOCS_WEIGHT * off(len(new), n) + splits.QUESTIONS_WEIGHT * off(sum(x["question_count"] for x in new), ratio * sum(x["question_count"] for x in docs))
            for kind, w in (("domain", splits.DOMAIN_WEIGHT), ("length_bucket", splits.BUCKET_WEIGHT)):
                total += w * sum(off(sum(x[kind] == k for x in new), t) for k, t in want[kind].items())
            return round(total, 12), -d["question_count"], -d["n_pages"], d["doc_id"]

        picked.append(min((d for d in docs if d not in picked), key=cost))
    assert [d["doc_id"] for d in splits.pick_balanced(docs, n)] == [d["doc_id"] for d in picked]


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.2, 1, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, delta double")
    got = analyses.bootstrap(df, 2000).first()
    means = [rng.choice(x, 400).mean() for _ in range(4000)]
    assert got.n == 400 and abs(got.low - np.quantile(means, 0.025)) < 0.02 and abs(got.high - np.quantile(means, 0.975)) < 0.02
    again = analyses.bootstrap(df.repartition(7), 2000).first()
    assert [round(x, 9) for x in again] == [round(x, 9) for x in got]


def test_bootstrap_of_many_metrics_and_nulls(spark):
    df = spark.createDataFrame([(i, i % 3 - 1.0, None if i % 4 else 2.0, None) for i in range(300)], "i long, a double, b double, c double")
    got = {r.metric: r for r in analyses.bootstrap_metrics(df, ["a", "b", "c"], 1000).collect()}
    assert (got["a"].n, got["b"].n, got["c"].n) == (300, 75, 0)
    assert got["a"].low < got["a"].delta < got["a"].high and got["b"].low == got["b"].high == 2.0 and got["c"].low is None and got["c"].delta is None
    none = analyses.bootstrap(df.select("i", F.col("a").alias("delta")).limit(0)).first()
    assert (none.n, none.delta, none.low, none.high) == (0, None, None, None)


def test_occurrences_are_poisson():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**32, 200, dtype=np.uint32) for _ in range(2))
    w = analyses.occurrences(a, b, 1000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01


def test_parity_of_unmatched_rows(spark):
    names = "Question_ID string, Correct_Answer string, Doc_ID string, Page_Num string"
    a, b = spark.createDataFrame([("1", "A", "d", "1"), ("2", "B", "d", "1")], names), spark.createDataFrame([("2", "C", "d", "1"), ("3", "B", "d", "1")], names)
    got = compare.prediction_parity(a, b).first().asDict()
    assert got == {"common": 1, "only_left": 1, "only_right": 1, "different": 1, "match": False}


def test_swings_in_the_right_document(spark):
    df = lambda *rows: spark.createDataFrame(rows, "Question_ID string, doc_correct double, page_proximity double")
    got = compare.same_doc_swings(df(("1", 1.0, 0.5), ("2", 1.0, 0.5), ("3", 0.0, 0.0), ("4", 1.0, 1.0)), df(("1", 1.0, 0.7), ("2", 1.0, 0.1), ("3", 1.0, 1.0), ("4", 1.0, 1.0))).first()
    assert (got.improved, got.regressed) == (1, 1)


def test_dealing_follows_round_robin(spark):
    docs = splits.doc_records(questions(spark, [5 + i % 7 for i in range(20)]))
    order = [r.doc_id for r in splits.round_robin(docs).orderBy("deal").collect()]
    assert list(splits.deal(sorted((r.asDict() for r in docs.collect()), key=lambda d: (-d["question_count"], -d["n_pages"], d["domain"], d["doc_id"])), 5)) == order


def test_tree_diff_keeps_missing_paths(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "path string, value double")
    b = spark.createDataFrame([("y", 5.0), ("z", 1.0)], "path string, value double")
    assert {r.path: r.delta for r in compare.tree_diff(a, b).collect()} == {"x": None, "y": 3.0, "z": None}


def test_parity_of_a_run_with_itself(spark):
    p = spark.createDataFrame([("1", "A", "d", "1")], "Question_ID string, Correct_Answer string, Doc_ID string, Page_Num string")
    m = spark.createDataFrame([("seed", "1")], "key string, value string")
    r = compare.parity_report(p, p, m, m).first()
    assert r.match and r.manifests_match


def test_dense_prefix_property(spark, small):
    from pagemill.plans.q_ranking import dense

    five = {(r.qid, r.rank, r.page_num) for r in dense(spark, small, 5).collect()}
    ten = {(r.qid, r.rank, r.page_num) for r in dense(spark, small, 10).collect() if r["rank"] <= 5}
    assert five == ten


def test_promotion_gate(spark):
    d = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.1), ("b", -0.1)], "candidate string, delta double")
    assert {r.candidate: r.promoted for r in analyses.promotion_gate(d).collect()} == {"a": True, "b": False}


def test_empty_rankings(spark):
    none = spark.createDataFrame([], RANKING)
    texts = spark.createDataFrame([], "doc_id string, page_num int, text string")
    assert rank.doc_ranking(none).count() == rank.guarded_ranking(none).count() == retrieve.rrf([none, none]).count() == 0
    assert answer.build_context(none, texts).count() == rank.doc_previews(none, texts).count() == 0


def test_report_and_repeats(spark):
    from pagemill.plans.config import repeats

    df = spark.createDataFrame([("d", 1, 1.0, 0.5, 0.25, 0.6875), ("all", 1, 1.0, 0.5, 0.25, 0.6875)], "scope string, n long, answer double, doc double, page double, composite double")
    assert metrics.report(df).splitlines()[0] == "all: n=1 answer=1.0000 doc=0.5000 page=0.2500 composite=0.6875"
    assert repeats(2, 7) == [{"seed": 7, "repeat": 0}, {"seed": 8, "repeat": 1}]


def test_retrieval_of_nulls_and_nothing(spark):
    pages = spark.createDataFrame([(1, 1, [1.0, 0.0], "a b"), (2, 1, None, None), (3, 1, [0.6, 0.8], "")], "doc_id long, page_num long, emb array<double>, text string")
    asked = spark.createDataFrame([(7, [1.0, 0.0], "b"), (8, None, None)], "qid long, emb array<double>, text string")
    assert [(r.qid, r.doc_id) for r in retrieve.dense_topk(pages, asked, 5).orderBy("rank").collect()] == [(7, 1), (7, 3)]
    assert retrieve.bm25_topk(pages, asked, 5).where("qid = 7").orderBy("rank").first().doc_id == 1
    assert retrieve.dense_topk(pages.limit(0), asked, 5).count() == retrieve.dense_topk(pages, asked.limit(0), 5).count() == 0
    assert retrieve.bm25_topk(pages.limit(0), asked, 5).count() == retrieve.bm25_topk(pages, asked.limit(0), 5).count() == 0


def test_rankings_send_k_rows_a_query_and_task(spark):
    """Ties at the last place, empty queries and repeated scores: exactly the first k by score, doc and page."""
    rng = np.random.default_rng(4)
    words = [" ".join(rng.choice(["a", "b", "c", "d"], 4)) for _ in range(500)]
    pages = spark.createDataFrame([(i // 7, i % 7, t, [float(x) for x in rng.integers(0, 2, 3)]) for i, t in enumerate(words)], "doc_id long, page_num long, text string, emb array<double>").repartition(3).cache()
    queries = spark.createDataFrame([(1, "a a b"), (2, ""), (3, "zzz"), (4, None)], "qid long, text string")
    got = [(r.qid, r.doc_id, r.page_num) for r in retrieve.bm25_topk(pages, queries, 5).orderBy("qid", "rank").collect()]
    assert [x[1:] for x in got if x[0] != 1] == [(0, i) for i in range(5)] * 3 and len(got) == 20
    asked = spark.createDataFrame([(1, [1.0, 0.5, 0.0]), (2, [0.0, 0.0, 0.0])], "qid long, emb array<double>")
    rows = pages.collect()
    want = [(q, r.doc_id, r.page_num) for q, v in ((1, (1.0, 0.5, 0.0)), (2, (0.0, 0.0, 0.0))) for r in sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(v, r.emb)), r.doc_id, r.page_num))[:9]]
    assert [(r.qid, r.doc_id, r.page_num) for r in retrieve.dense_topk(pages, asked, 9).orderBy("qid", "rank").collect()] == want
    best = retrieve.Best(3, 2)
    for _ in range(40):
        best.add(0, rng.integers(0, 3, (50, 3)).astype(float), np.arange(50), np.zeros(50, np.int64))
    assert max(len(x[0]) for x in best.parts) <= 6 and best.rows(np.arange(3)).num_rows == 6


def test_chunk_scores_are_bounded_and_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(p % 3), int(p), rng.integers(-3, 4, 4).astype(float).tolist()) for p in range(300) for _ in range(3)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "doc_id long, page_num long, emb array<double>").repartition(4)
    asked = [(q, d, rng.integers(-3, 4, 4).astype(float).tolist()) for q in range(7) for d in (0, 2, 9)]
    got = retrieve.chunk_scores(chunks, spark.createDataFrame(asked, "qid long, doc_id long, emb array<double>"), 6).collect()
    # a task sends on six pages of a pair, whatever the number of the document's chunks
    assert len(got) <= 4 * 14 * 6
    found = {}
    for r in got:
        key = (r["qid"], r["doc_id"], r["page_num"])
        found[key] = max(found.get(key, -1e9), r["score"])
    for q, d, emb in asked:
        best = {}
        for doc, page, x in rows:
            if doc == d:
                best[page] = max(best.get(page, -1e9), float(np.dot(x, emb)))
        want = sorted(best.items(), key=lambda y: (-y[1], y[0]))[:6]
        mine = sorted(((k[2], v) for k, v in found.items() if k[:2] == (q, d)), key=lambda y: (-y[1], y[0]))[:6]
        assert mine == want


def test_best_holds_small_blocks_and_stays_exact():
    import tracemalloc

    rng = np.random.default_rng(3)
    n, k, rows, step = 2500, 5, min(retrieve.ROWS, 2000), retrieve.COLUMNS
    emb, queries = rng.integers(-2, 3, (3 * rows, 4)).astype(float), rng.integers(-2, 3, (n, 4)).astype(float)
    best = retrieve.Best(n, k)
    tracemalloc.start()
    for low in range(0, len(emb), rows):
        doc = np.arange(low, low + rows)
        for q in range(0, n, step):
            best.add(q, emb[low : low + rows] @ queries[q : q + step].T, doc, doc)
    # blocks of 4 MB of scores, whatever the number of queries (before: 32 MB, five at a time)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    q, score, doc, _ = best.cut()
    for i in range(0, n, 97):
        want = np.lexsort((np.arange(len(emb)), -(emb @ queries[i])))[:k]
        assert doc[q == i].tolist() == want.tolist()


def test_arrow_batches_of_rankings_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(1, 1, "a b c")], "doc_id long, page_num long, text string")
    retrieve.bm25_topk(docs, spark.createDataFrame([(1, "a")], "qid long, text string"), 2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
