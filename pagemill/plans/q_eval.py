"""Queries of scoring, run comparison, splits and analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import analyses, compare, metrics, splits
from pagemill.plans.q_ranking import _GUARD, _RANKED, _ranked, dense
from pagemill.plans.registry import DOCS, TRUTH, dense_sql, query, run_predictions, run_sql, table, truth, vec_queries

#: Bytes of a table's files for each part of a deal by pair.
PART_BYTES = 8 << 20

R = lambda c, n=6: F.round(c, n).alias(c)
A, B = run_sql("a", 0), run_sql("b", 1)


def scored(spark, d, k):
    return metrics.score_questions(truth(spark, d), run_predictions(spark, d, k))


@query(f"WITH {TRUTH}, {A} SELECT Question_ID, Domain, n_pages, true_answer, true_doc, true_page, pred_answer, pred_doc, pred_page, answer_correct, doc_correct, round(page_proximity, 6) AS page_proximity, round(score, 6) AS score FROM a")
def score_per_question(spark, d):
    s = scored(spark, d, 0)
    return s.select("Question_ID", "Domain", "n_pages", "true_answer", "true_doc", "true_page", "pred_answer", "pred_doc", "pred_page", "answer_correct", "doc_correct", R("page_proximity"), R("score"))


@query(f"WITH {TRUTH}, {A} SELECT CASE WHEN grouping(Domain) = 1 THEN 'all' ELSE Domain END AS scope, count(*) AS n, round(avg(answer_correct), 6) AS answer, round(avg(doc_correct), 6) AS doc, round(avg(page_proximity), 6) AS page, round(avg(score), 6) AS composite FROM a GROUP BY GROUPING SETS ((), (Domain))")
def evaluate_grouped(spark, d):
    return metrics.evaluate(scored(spark, d, 0)).select("scope", "n", R("answer"), R("doc"), R("page"), R("composite"))


_DIFF = "diff AS (SELECT a.Question_ID, a.Domain, a.score AS left_score, b.score AS right_score, round(b.score - a.score, 9) AS delta, a.pred_answer IS DISTINCT FROM b.pred_answer AS answer_changed, a.pred_doc IS DISTINCT FROM b.pred_doc AS doc_changed, a.pred_page IS DISTINCT FROM b.pred_page AS page_changed FROM a JOIN b USING (Question_ID))"
_STATUS = "CASE WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'regressed' ELSE 'unchanged' END"


def diff(spark, d):
    return compare.run_diff(scored(spark, d, 0), scored(spark, d, 1))


@query(f"WITH {TRUTH}, {A}, {B}, {_DIFF} SELECT Question_ID, Domain, round(left_score, 6) AS left_score, round(right_score, 6) AS right_score, round(delta, 6) AS delta, {_STATUS} AS status, answer_changed, doc_changed, page_changed FROM diff")
def run_diff(spark, d):
    return diff(spark, d).select("Question_ID", "Domain", R("left_score"), R("right_score"), R("delta"), "status", "answer_changed", "doc_changed", "page_changed")


_SUMMARY = f"""summary AS (SELECT CASE WHEN grouping(Domain) = 1 THEN 'all' ELSE Domain END AS Domain, count(*) AS n, round(avg(delta), 6) AS mean_delta, count(*) FILTER (WHERE delta > 0) AS improved, count(*) FILTER (WHERE delta < 0) AS regressed, count(*) FILTER (WHERE delta = 0) AS unchanged, round(avg(answer_changed::INTEGER), 6) AS answer_changed_rate, round(avg(doc_changed::INTEGER), 6) AS doc_changed_rate, round(avg(page_changed::INTEGER), 6) AS page_changed_rate FROM diff GROUP BY GROUPING SETS ((), (Domain)))"""


def diff_summary(spark, d):
    return compare.run_diff_summary(diff(spark, d)).select("Domain", "n", R("mean_delta"), "improved", "regressed", "unchanged", R("answer_changed_rate"), R("doc_changed_rate"), R("page_changed_rate"))


@query(f"WITH {TRUTH}, {A}, {B}, {_DIFF}, {_SUMMARY} SELECT * FROM summary")
def run_diff_domain(spark, d):
    return diff_summary(spark, d)


@query(f"WITH {TRUTH}, {A}, {B}, {_DIFF}, {_SUMMARY} SELECT doc_flip, worst_domain, round(doc_flip, 9) < 0.05 AND round(worst_domain, 9) <= 0.01 AS safe FROM (SELECT max(CASE WHEN Domain = 'all' THEN doc_changed_rate END) AS doc_flip, max(CASE WHEN Domain <> 'all' THEN abs(mean_delta) END) AS worst_domain FROM summary)")
def risk_filter(spark, d):
    return analyses.risk_filter(diff_summary(spark, d))


@query(f"WITH {TRUTH}, {A}, {B}, {_DIFF} SELECT 'delta' AS metric, round(avg(CASE WHEN Domain = 'domain_1' THEN delta END), 6) AS domain_1, round(avg(CASE WHEN Domain = 'domain_2' THEN delta END), 6) AS domain_2 FROM diff")
def domain_deltas(spark, d):
    return analyses.domain_deltas(diff(spark, d), ["domain_1", "domain_2"]).select("metric", R("domain_1"), R("domain_2"))


@query(f"""WITH {dense_sql()}, {_RANKED}, l AS (SELECT qid, rank FROM ranked WHERE stage = 'dense_page'), r AS (SELECT qid, rank FROM ranked WHERE stage = 'guarded_doc')
SELECT 'final' AS stage, count(*) AS n, count(*) FILTER (WHERE coalesce(l.rank, 0) <> 1 AND r.rank = 1) AS fixed, count(*) FILTER (WHERE l.rank = 1 AND coalesce(r.rank, 0) <> 1) AS broken, count(*) FILTER (WHERE coalesce(r.rank, 2147483647) < coalesce(l.rank, 2147483647)) AS improved, count(*) FILTER (WHERE coalesce(r.rank, 2147483647) > coalesce(l.rank, 2147483647)) AS regressed FROM l JOIN r USING (qid)""")
def ir_swings(spark, d):
    ranked = _ranked(spark, d)
    pick = lambda s: ranked.where(F.col("stage") == s).select("qid", F.lit("final").alias("stage"), "rank")
    return compare.ir_swings(pick("dense_page"), pick("guarded_doc"))


@query("""WITH l AS (SELECT 'event.' || event_type AS path, round(avg(value), 6) AS value FROM events WHERE event_type <> 'click' GROUP BY event_type), r AS (SELECT 'event.' || event_type AS path, round(max(value), 6) AS value FROM events WHERE event_type <> 'view' GROUP BY event_type)
SELECT path, l.value AS "left", r.value AS "right", round(r.value - l.value, 6) AS delta FROM l FULL JOIN r USING (path)""")
def metric_tree_diff(spark, d):
    e = table(spark, d, "events")
    path = F.concat(F.lit("event."), "event_type").alias("path")
    left = e.where("event_type <> 'click'").groupBy(path).agg(F.round(F.avg("value"), 6).alias("value"))
    right = e.where("event_type <> 'view'").groupBy(path).agg(F.round(F.max("value"), 6).alias("value"))
    return compare.tree_diff(left, right).select("path", "left", "right", R("delta"))


@query("""WITH t AS (SELECT click_id // 2 AS id, click_id % 2 AS side, any_value(CASE WHEN json_valid(props) THEN props ELSE '{}' END) AS tree FROM clicks WHERE click_id IS NOT NULL GROUP BY click_id),
n AS (SELECT t.id, t.side, replace(j.fullkey, '"', '') AS path, j.type = 'OBJECT' AS opens, CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN j.value::VARCHAR::DOUBLE WHEN j.type = 'BOOLEAN' THEN j.value::VARCHAR::BOOLEAN::DOUBLE END AS value FROM t, json_tree(t.tree) j WHERE NOT contains(j.fullkey, '[')),
b AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.path, r.path) AS path, l.value AS a, r.value AS b, coalesce(l.opens, false) AND coalesce(r.opens, false) AS open FROM (SELECT * FROM n WHERE side = 0) l FULL JOIN (SELECT * FROM n WHERE side = 1) r ON l.id = r.id AND l.path = r.path)
SELECT x.id::VARCHAR AS id, substr(x.path, 3) AS path, x.a AS "left", x.b AS "right", x.b - x.a AS delta FROM b x WHERE NOT x.open AND (x.path = '$' OR EXISTS (SELECT 1 FROM b y WHERE y.open AND y.id = x.id AND y.path = regexp_replace(x.path, '\\.[^.]*$', '')))""")
def metric_tree_json_diff(spark, d):
    """Trees of any shape: the properties of each click with an even number and of the one after it."""
    clicks = table(spark, d, "clicks").where("click_id is not null").select(F.expr("click_id div 2").cast("string").alias("id"), "click_id", "props")
    # dealt once, by pair, into parts of a bounded size: repeats of a click and both sides of a pair meet there, so that no task sorts more at a larger input
    size = int(str(clicks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    dealt = clicks.repartition(max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)), "id")
    props = dealt.groupBy("id", "click_id").agg(F.any_value("props").alias("tree"))
    side = lambda k: props.where(F.col("click_id") % 2 == k).select("id", "tree")
    return compare.metric_tree_diff(side(0), side(1))


_SIDES = "l AS (SELECT * FROM a_p), r AS (SELECT * FROM b_p)"


@query(f"""WITH {TRUTH}, {A}, {B}, {_SIDES}, j AS (SELECT l.Question_ID AS x, r.Question_ID AS y, (l.pred_answer, l.pred_doc, l.pred_page) IS DISTINCT FROM (r.pred_answer, r.pred_doc, r.pred_page) AS differ FROM l FULL JOIN r ON l.Question_ID = r.Question_ID),
s AS (SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (WHERE y IS NULL) AS only_left, count(*) FILTER (WHERE x IS NULL) AS only_right, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND differ) AS different FROM j)
SELECT *, only_left = 0 AND only_right = 0 AND different = 0 AS match FROM s""")
def prediction_parity(spark, d):
    return compare.prediction_parity(run_predictions(spark, d, 0), run_predictions(spark, d, 1))


@query(f"WITH {TRUTH}, {A}, {B} SELECT Question_ID, l.pred_answer <> r.pred_answer AS answer_changed, l.pred_doc <> r.pred_doc AS doc_changed, l.pred_page <> r.pred_page AS page_changed FROM a_p l JOIN b_p r USING (Question_ID)")
def prediction_diff(spark, d):
    out = compare.prediction_diff(run_predictions(spark, d, 0), run_predictions(spark, d, 1))
    return out.select("Question_ID", F.col("Correct_Answer_changed").alias("answer_changed"), F.col("Doc_ID_changed").alias("doc_changed"), F.col("Page_Num_changed").alias("page_changed"))


@query("SELECT coalesce(a.key, b.key) AS key, a.value AS \"left\", b.value AS \"right\" FROM (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name AS key, (n_nationkey % 5)::VARCHAR AS value FROM nation WHERE n_nationkey >= 5) b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def manifest_diff(spark, d):
    n = table(spark, d, "nation")
    left = n.where("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    right = n.where("n_nationkey >= 5").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 5).cast("string").alias("value"))
    return compare.manifest_diff(left, right)


# -- splits


@query("""WITH docs AS (SELECT label::VARCHAR AS doc_id, 'domain_' || (label % 2 + 1)::VARCHAR AS domain, 10 + label * 7 AS n_pages, count(*) AS question_count FROM embeddings GROUP BY label)
SELECT doc_id, domain, n_pages, question_count, 'q' || (least(3, floor((row_number() OVER (ORDER BY n_pages, doc_id) - 1) / greatest(1, ceil(count(*) OVER () / 4.0)))) + 1)::BIGINT::VARCHAR AS length_bucket FROM docs""")
def split_length_buckets(spark, d):
    return splits.doc_records(truth(spark, d))


@query("""WITH docs AS (SELECT label::VARCHAR AS doc_id, 'domain_' || (label % 2 + 1)::VARCHAR AS domain, 10 + label * 7 AS n_pages, count(*) AS question_count FROM embeddings GROUP BY label),
b AS (SELECT *, 'q' || (least(3, floor((row_number() OVER (ORDER BY n_pages, doc_id) - 1) / greatest(1, ceil(count(*) OVER () / 4.0)))) + 1)::BIGINT::VARCHAR AS length_bucket FROM docs),
t AS (SELECT *, row_number() OVER (PARTITION BY domain, length_bucket ORDER BY question_count DESC, n_pages DESC, domain, doc_id) AS turn FROM b)
SELECT doc_id, length_bucket, turn, row_number() OVER (ORDER BY turn, domain, length_bucket) AS deal FROM t""")
def split_round_robin(spark, d):
    return splits.round_robin(splits.doc_records(truth(spark, d))).select("doc_id", "length_bucket", "turn", "deal")


@query(f"WITH {TRUTH}, dom AS (SELECT DISTINCT Domain AS held_out FROM truth) SELECT held_out, role, count(*) AS n FROM (SELECT held_out, CASE WHEN Domain = held_out THEN 'val' ELSE 'train' END AS role FROM truth CROSS JOIN dom) GROUP BY held_out, role")
def split_lodo(spark, d):
    return splits.leave_one_domain_out(truth(spark, d)).groupBy("held_out", "role").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def split_folds(spark, d):
    return splits.protocol(splits.doc_records(truth(spark, d)))


@query(None)
def split_lockbox(spark, d):
    docs = splits.doc_records(truth(spark, d))
    return splits.summary(docs, splits.protocol(docs).where("role = 'lockbox'"))


@query(f"WITH {TRUTH} SELECT Question_ID, Domain FROM truth WHERE true_doc NOT IN (SELECT label::VARCHAR FROM embeddings GROUP BY label HAVING label % 3 = 0)")
def split_antijoin(spark, d):
    val = table(spark, d, "embeddings").select("label").distinct().where("label % 3 = 0").select(F.col("label").cast("string").alias("Doc_ID"))
    return truth(spark, d).join(val, "Doc_ID", "left_anti").select("Question_ID", "Domain")


# -- analyses


_WEIGHT = "CASE " + " ".join(f"WHEN h < {t} THEN {w}" for w, t in enumerate(analyses.POISSON)) + f" ELSE {len(analyses.POISSON)} END"


def _resamples(source: str, names: list[str]) -> str:
    """SQL of ``means``: the mean of each of ``names`` in each resample of ``source`` (i and these columns)."""
    cut = lambda x: f"({x}) & 4294967295"
    columns = ", ".join(names)
    step = lambda e, inner: f"SELECT {columns}, b, r, {e} AS h FROM ({inner})"

    def mixed(inner: str) -> str:
        for shift, factor in zip((16, 13), analyses.FACTORS):
            inner = step(cut(f"xor(h, h >> {shift}) * {factor}"), inner)
        return step("xor(h, h >> 16)", inner)

    keys = f"SELECT {columns}, ('0x' || substr(md5('42:' || i), 1, 8))::UBIGINT AS a, ('0x' || substr(md5('42:' || i), 9, 8))::UBIGINT AS b FROM {source}"
    start = f"SELECT {columns}, b, r, {cut(f'a + r * {analyses.STEP}')} AS h FROM ({keys}) CROSS JOIN (SELECT unnest(range(0, {analyses.ITERATIONS}))::UBIGINT AS r)"
    drawn = step(_WEIGHT, mixed(step("xor(h, b)", mixed(start))))
    return f"means AS (SELECT r, {', '.join(f'sum({c} * h) / sum(h) AS {c}' for c in names)} FROM ({drawn}) GROUP BY r)"


@query(f"""WITH {TRUTH}, {A}, {B}, {_DIFF}, keyed AS (SELECT Question_ID AS i, delta FROM diff), {_resamples("keyed", ["delta"])}
SELECT (SELECT round(avg(delta), 6) FROM diff) AS delta, (SELECT count(*) FROM diff) AS n, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high FROM means""")
def bootstrap_ci(spark, d):
    return analyses.bootstrap(diff(spark, d).select(F.col("Question_ID").alias("i"), "delta")).select(R("delta"), "n", R("low"), R("high"))


_DELTAS = "deltas AS (SELECT Question_ID AS i, " + ", ".join(f"round(b.{c} - a.{c}, 9) AS {m}" for m, c in analyses.METRICS.items()) + " FROM a JOIN b USING (Question_ID))"
_ENDS = " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT round(avg({m}), 6) FROM deltas) AS delta, (SELECT count({m}) FROM deltas) AS n, round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.975), 6) AS high FROM means" for m in analyses.METRICS)


@query(f"WITH {TRUTH}, {A}, {B}, {_DELTAS}, {_resamples('deltas', list(analyses.METRICS))} {_ENDS}")
def bootstrap_metrics(spark, d):
    found = analyses.bootstrap_metrics(analyses.metric_deltas(scored(spark, d, 0), scored(spark, d, 1)), list(analyses.METRICS))
    return found.select("metric", R("delta"), "n", R("low"), R("high"))


@query(f"WITH {TRUTH}, {A}, {B} SELECT count(*) FILTER (WHERE b.page_proximity > a.page_proximity) AS improved, count(*) FILTER (WHERE b.page_proximity < a.page_proximity) AS regressed FROM a JOIN b USING (Question_ID) WHERE a.doc_correct = 1 AND b.doc_correct = 1")
def same_doc_swings(spark, d):
    return compare.same_doc_swings(scored(spark, d, 0), scored(spark, d, 1))


_CDF = ", ".join(f"round(avg(CASE WHEN dist <= {t} THEN 1.0 ELSE 0.0 END), 6) AS within_{t}" for t in analyses.DISTANCES)


@query(f"WITH {TRUTH}, {A}, w AS (SELECT Domain, abs(pred_page - true_page) AS dist FROM a WHERE doc_correct = 1 AND pred_page <> true_page) SELECT CASE WHEN grouping(Domain) = 1 THEN 'all' ELSE Domain END AS Domain, count(*) AS n, {_CDF}, quantile_cont(dist, 0.5)::DOUBLE AS median, round(avg(dist), 6) AS mean FROM w GROUP BY GROUPING SETS ((), (Domain))")
def page_distance_cdf(spark, d):
    return analyses.page_distances(scored(spark, d, 0)).select("Domain", "n", *[R(f"within_{t}") for t in analyses.DISTANCES], "median", R("mean"))


@query(f"WITH {TRUTH}, {A}, c AS (SELECT CASE WHEN answer_correct = 1 AND doc_correct = 1 AND page_proximity = 1 THEN 'all_correct' WHEN answer_correct = 1 AND doc_correct = 1 THEN 'only_page_wrong' WHEN answer_correct = 1 THEN 'only_answer_right' WHEN doc_correct = 1 AND page_proximity = 1 THEN 'only_answer_wrong' WHEN doc_correct = 1 THEN 'only_doc_right' ELSE 'all_wrong' END AS error FROM a) SELECT error, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY error")
def error_taxonomy(spark, d):
    return analyses.error_taxonomy(scored(spark, d, 0)).select("error", "n", R("share"))


_GATE = """runs AS (SELECT 'sys' || (vec_id % 7)::VARCHAR AS system, 'split_' || (vec_id % 3)::VARCHAR AS split, round(avg(abs(embedding[1])), 6) AS composite FROM embeddings GROUP BY 1, 2)"""


def runs(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy(F.concat(F.lit("sys"), (F.col("vec_id") % 7).cast("string")).alias("system"), F.concat(F.lit("split_"), (F.col("vec_id") % 3).cast("string")).alias("split")).agg(F.round(F.avg(F.abs(F.col("embedding")[0].cast("double"))), 6).alias("composite"))


@query(f"WITH {_GATE.replace('embedding[1]', 'embedding[1]::DOUBLE')} SELECT r.system, r.split, r.composite, round(r.composite - b.composite, 6) AS delta FROM runs r LEFT JOIN runs b ON b.split = r.split AND b.system = 'sys0'")
def ablation_ledger(spark, d):
    return analyses.ablation_ledger(runs(spark, d), "sys0").select("system", "split", "composite", R("delta"))


@query(f"WITH {_GATE.replace('embedding[1]', 'embedding[1]::DOUBLE')} SELECT r.system AS candidate, bool_and(round(r.composite - b.composite, 6) > 0) AS promoted, count(*) AS splits FROM runs r JOIN runs b ON b.split = r.split AND b.system = 'sys0' WHERE r.system <> 'sys0' GROUP BY r.system")
def promotion_gate(spark, d):
    ledger = analyses.ablation_ledger(runs(spark, d), "sys0").where("system <> 'sys0'")
    return analyses.promotion_gate(ledger.select(F.col("system").alias("candidate"), R("delta")))


@query("""WITH remote AS (SELECT n_name AS system, n_nationkey::DOUBLE / 100 AS public, n_regionkey::DOUBLE / 10 AS private FROM nation), loc AS (SELECT n_name AS system, n_nationkey::DOUBLE / 50 AS local FROM nation WHERE n_regionkey <> 2)
SELECT r.system, local, public, private, round(public - local, 6) AS public_delta, round(private - local, 6) AS private_delta FROM remote r LEFT JOIN loc USING (system)""")
def leaderboard(spark, d):
    n = table(spark, d, "nation")
    remote = n.select(F.col("n_name").alias("system"), (F.col("n_nationkey") / 100).alias("public"), (F.col("n_regionkey") / 10).alias("private"))
    local = n.where("n_regionkey <> 2").select(F.col("n_name").alias("system"), (F.col("n_nationkey") / 50).alias("local"))
    return analyses.leaderboard(local, remote).select("system", "local", "public", "private", R("public_delta"), R("private_delta"))


@query(f"""WITH {dense_sql()}, {DOCS}, {_GUARD}, hit AS (SELECT q.qid, min(r.rank) AS rank FROM q LEFT JOIN docs r ON r.qid = q.qid AND r.doc_id = q.truth GROUP BY q.qid),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || qid::VARCHAR), 1, 8))::BIGINT, qid) AS n FROM hit) WHERE n <= 100)
SELECT k, count(*) AS n, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM chosen CROSS JOIN (SELECT unnest([0, 1, 2, 3, 5]) AS k) GROUP BY k""")
def context_sweep(spark, d):
    from pagemill.operators import rank

    want = vec_queries(spark, d).select("qid", F.col("truth").alias("doc_id"))
    ranked = metrics.rank_of(rank.doc_ranking(dense(spark, d)), want, ["doc_id"])
    return analyses.context_sweep(ranked).select("k", "n", R("accuracy"))


@query("""WITH t AS (SELECT vec_id::VARCHAR AS Question_ID, 'domain_' || (label % 2 + 1)::VARCHAR AS Domain, label::VARCHAR AS Doc_ID, 10 + label * 7 AS n_pages FROM embeddings),
docs AS (SELECT Domain, Doc_ID, max(n_pages) AS n_pages, row_number() OVER (PARTITION BY Domain ORDER BY Doc_ID) - 1 AS i FROM t GROUP BY Domain, Doc_ID), sizes AS (SELECT Domain, count(*) AS n_docs FROM docs GROUP BY Domain),
p AS (SELECT Question_ID, t.Domain, ('0x' || substr(md5('42:doc:' || Question_ID), 1, 8))::BIGINT % n_docs AS i, ('0x' || substr(md5('42:letter:' || Question_ID), 1, 8))::BIGINT % 6 AS l, ('0x' || substr(md5('42:page:' || Question_ID), 1, 8))::BIGINT AS g FROM t JOIN sizes USING (Domain))
SELECT Question_ID, substr('ABCDEF', (l + 1)::INTEGER, 1) AS Correct_Answer, Doc_ID, (g % n_pages + 1)::VARCHAR AS Page_Num FROM p JOIN docs USING (Domain, i)""")
def random_baseline(spark, d):
    return metrics.random_baseline(truth(spark, d))
