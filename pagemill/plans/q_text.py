"""Queries of text preparation: tokens, bleed, segments, headings, summaries, chunks, prompts, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import answer as an
from pagemill.operators import retrieve
from pagemill.plans.registry import TEXT_PAGES, TURN_PAGES, lines_sql, query, strip_sql, table, text_pages, tokens_sql, turn_pages


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_stats(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {TURN_PAGES} SELECT doc_id, page_num, md5({strip_sql('''coalesce(right(lag(text) OVER w, 200), '') || text || coalesce(left(lead(text) OVER w, 200), '')''')}) AS bled FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)")
def neighbor_bleed(spark, d):
    return retrieve.neighbor_bleed(turn_pages(spark, d), 200).select("doc_id", "page_num", F.md5("bled").alias("bled"))


_SEGMENTS = f"""cut AS (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 900 + 1), 512)) AS start FROM documents),
seg AS (SELECT doc_id, start, {strip_sql("substr(text, start + 1, 900)")} AS segment FROM cut),
segs AS (SELECT doc_id, start, segment FROM seg WHERE segment <> '' UNION ALL SELECT doc_id, 0, left(text, 900) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM seg WHERE segment <> ''))"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, start::INTEGER AS start, length(segment) AS n_chars, md5(segment) AS digest FROM segs")
def text_segments(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_num"), "text")
    return retrieve.segment_rows(rows, 900, 512).select("doc_id", "start", F.length("segment").cast("long").alias("n_chars"), F.md5("segment").alias("digest"))


@query(f"WITH {_SEGMENTS}, per AS (SELECT doc_id, count(*) AS n, sum(length(segment)) AS chars FROM segs GROUP BY doc_id) SELECT lang, count(*) AS docs, sum(n)::BIGINT AS segments, sum(chars)::BIGINT AS chars FROM per JOIN documents USING (doc_id) GROUP BY lang")
def segment_stats(spark, d):
    docs = table(spark, d, "documents")
    # lengths are summed inside each document's array, so segments are never exploded
    s = docs.select("lang", tx.segments("text", 900, 512).alias("s"))
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("s")).alias("segments"), F.sum(F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["segment"]))).alias("chars"))


@query(f"""WITH {TEXT_PAGES}, l AS (SELECT doc_id, page_num, {strip_sql("text")} AS line FROM pages_v),
h AS (SELECT *, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) AS upper FROM l)
SELECT doc_id, page_num, md5(line) AS line FROM h WHERE line <> '' AND length(line) <= 120 AND letters > 0 AND (upper::DOUBLE / letters >= 0.6 OR line LIKE '%:' OR regexp_matches(line, '^[\\p{{Nd}}]'))""")
def heading_lines(spark, d):
    stripped = text_pages(spark, d).select("doc_id", "page_num", tx.strip("text").alias("line"))
    return stripped.where(tx.heading_like("line", 120)).select("doc_id", "page_num", F.md5("line").alias("line"))


@query(f"""WITH dl AS (SELECT doc_id, text, {lines_sql("text")} AS ls FROM documents),
ll AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM dl),
hh AS (SELECT *, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) AS upper FROM ll),
heads AS (SELECT doc_id, arg_min(line, i) AS heading FROM hh WHERE length(line) <= 120 AND letters > 0 AND (upper::DOUBLE / letters >= 0.6 OR line LIKE '%:' OR regexp_matches(line, '^[\\p{{Nd}}]')) GROUP BY doc_id),
body AS (SELECT l.doc_id, l.i, l.line, coalesce(sum(length(l.line) + 1) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ll l LEFT JOIN heads USING (doc_id) WHERE l.i <= 12 AND l.line <> coalesce(heading, '')),
joined AS (SELECT doc_id, {strip_sql("left(string_agg(line, ' ' ORDER BY i), 320)")} AS body FROM body WHERE before < 320 GROUP BY doc_id)
SELECT dl.doc_id, md5(CASE WHEN coalesce(heading, '') <> '' AND coalesce(body, '') <> '' THEN '[Сторінка 1] ' || heading || ' ' || body WHEN coalesce(body, '') <> '' THEN '[Сторінка 1] ' || body ELSE '[Сторінка 1] ' || {strip_sql("left(text, 320)")} END) AS summary FROM dl LEFT JOIN heads USING (doc_id) LEFT JOIN joined USING (doc_id)""")
def page_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.page_summary("text", F.lit(1))).alias("summary"))


@query(None)
def structure_chunks(spark, d):
    """A sequential fold; tests hold it against a plain restatement."""
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(tx.structure_chunks("text", F.lit(1))).alias("chunk_no", "chunk"))
    return cut.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


_ANSWER = f"""coalesce(nullif(regexp_extract(upper(s), '^([A-F])', 1), ''), nullif(translate(regexp_extract(s, '^([АВСДЕФавсдеф])', 1), 'АВСДЕФавсдеф', 'ABCDEFABCDEF'), ''), nullif(regexp_extract(' ' || upper(s) || ' ', '[^\\p{{L}}\\p{{M}}\\p{{N}}_]([A-F])[^\\p{{L}}\\p{{M}}\\p{{N}}_]', 1), ''), nullif(regexp_extract(upper(s), '([A-F])', 1), ''), 'A')"""


@query(f"SELECT conv_id, turn, {_ANSWER} AS letter FROM (SELECT conv_id, turn, {strip_sql('text')} AS s FROM conversations)")
def extract_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.answer("text").alias("letter"))


_OPT = "'A. ' || text || chr(10) || 'B. ' || reverse(text) || chr(10) || 'C. ' || left(text, 20) || chr(10) || 'D. ' || right(text, 20) || chr(10) || 'E. e' || chr(10) || 'F. f'"
_ASKED = "'Питання: ' || text"
_NN = " || chr(10) || chr(10) || "


@query(f"""SELECT item_id, md5('ctx'{_NN}{_ASKED}{_NN}'Варіанти:' || chr(10) || {_OPT}{_NN}'Відповідь (лише буква):') AS direct,
md5('Документ:' || chr(10) || 'ctx'{_NN}{_ASKED}{_NN}'Варіанти:' || chr(10) || {_OPT}{_NN}{_ASKED} || chr(10) || 'Правильний варіант:') AS refocus,
md5('Документ:' || chr(10) || 'ctx'{_NN}{_ASKED}{_NN}'Варіанти:' || chr(10) || {_OPT}{_NN}'Знайди відповідний фрагмент тексту, потім вибери правильний варіант.' || chr(10) || 'Правильний варіант:') AS evidence,
md5(text || ' ' || reverse(text)) AS augmented FROM benchmark""")
def prompt_build(spark, d):
    options = {"A": F.col("text"), "B": F.reverse("text"), "C": F.left("text", F.lit(20)), "D": F.right("text", F.lit(20)), "E": F.lit("e"), "F": F.lit("f")}
    made = {"direct": "direct", "refocus": "v5_refocus", "evidence": "v4_evidence"}
    as_map = F.create_map(*[x for k, v in options.items() for x in (F.lit(k), v)])
    return table(spark, d, "benchmark").select("item_id", *[F.md5(tx.prompt(F.lit("ctx"), "text", options, v)).alias(k) for k, v in made.items()], F.md5(tx.augmented("text", as_map, F.lit("B"))).alias("augmented"))


_PAIR = f"'<|im_start|>system' || chr(10) || '{tx.PAIR_SYSTEM}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<Instruct>: {tx.PAIR_INSTRUCT}' || chr(10) || '<Query>: q' || chr(10) || '<Document>: ' || left(text, 4000) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10)"


@query(f"SELECT doc_id, md5({_PAIR}) AS pair FROM documents")
def pair_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.pair_text(F.lit("q"), "text")).alias("pair"))


_VOTES = f"votes AS (SELECT conv_id AS qid, turn AS pass_no, {_ANSWER} AS letter FROM (SELECT conv_id, turn, {strip_sql('text')} AS s FROM conversations WHERE role = 'assistant'))"


def votes(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pass_no"), tx.answer("text").alias("letter"))


@query(f"WITH {_VOTES}, c AS (SELECT qid, letter, count(*) AS n, min(pass_no) AS first FROM votes GROUP BY qid, letter) SELECT qid, arg_max(letter, n * 1000000 - first) AS letter, sum(n)::BIGINT AS n_votes, round(max(n)::DOUBLE / sum(n), 6) AS confidence FROM c GROUP BY qid")
def majority_vote(spark, d):
    return an.majority(votes(spark, d)).select("qid", "letter", "n_votes", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_VOTES}, k AS (SELECT qid, CASE WHEN count(DISTINCT letter) = 1 THEN 'unanimous' WHEN count(DISTINCT letter) = count(*) THEN 'all_different' ELSE 'majority' END AS kind FROM votes GROUP BY qid) SELECT kind, count(*) AS n, round(avg(CASE WHEN qid % 3 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY kind")
def vote_consistency(spark, d):
    from pagemill.operators.analyses import vote_consistency as consistency

    v = votes(spark, d)
    return consistency(v, v.select("qid", (F.col("qid") % 3 != 0).alias("correct")).distinct()).select("kind", "n", F.round("accuracy", 6).alias("accuracy"), F.round("share", 6).alias("share"))


@query(f"WITH {_VOTES}, other AS (SELECT qid, pass_no, substr('BCDEFA', strpos('ABCDEF', letter), 1) AS letter FROM votes WHERE qid % 2 = 1), last AS (SELECT qid, max(pass_no) AS last FROM votes GROUP BY qid), every AS (SELECT * FROM votes UNION ALL SELECT qid, last + pass_no, letter FROM other JOIN last USING (qid)), c AS (SELECT qid, letter, count(*) AS n, min(pass_no) AS first FROM every GROUP BY qid, letter) SELECT qid, arg_max(letter, n * 1000000 - first) AS letter, sum(n)::BIGINT AS n_votes FROM c GROUP BY qid")
def dual_context_vote(spark, d):
    v = votes(spark, d)
    other = v.withColumn("letter", F.translate("letter", "ABCDEF", "BCDEFA"))
    contexts = v.select("qid", F.lit("x").alias("context"), F.when(F.col("qid") % 2 == 1, "y").otherwise("x").alias("other_context")).distinct()
    return an.majority(an.dual_votes(v, other, contexts)).select("qid", "letter", "n_votes")


@query("""WITH e AS (SELECT event_id, event_type AS run, ts, value, row_number() OVER w AS done, sum(round(value, 4)::DECIMAL(18, 4)) OVER w AS elapsed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, elapsed::DOUBLE + elapsed::DOUBLE / done * greatest(5000 - done, 0) AS projected FROM e),
t AS (SELECT *, done >= 25 AND round(projected, 6) > 250000 AS trips FROM p)
SELECT event_id, run, done, round(projected, 4) AS projected, max(trips::INTEGER) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS fast FROM t""")
def runtime_governor(spark, d):
    steps = table(spark, d, "events").select("event_id", F.col("event_type").alias("run"), "ts", F.round("value", 4).cast("decimal(18,4)").alias("seconds"))
    out = an.governor(steps, 5000, 250000.0).withColumn("projected", F.col("elapsed").cast("double") + F.col("elapsed").cast("double") / F.col("done") * F.greatest(F.lit(5000) - F.col("done"), F.lit(0)))
    return out.select("event_id", "run", F.col("done").cast("long").alias("done"), F.round("projected", 4).alias("projected"), "fast")


@query(f"WITH {TEXT_PAGES}, per AS (SELECT domain, doc_id, count(*) AS pages, sum(CASE WHEN length(text) < 50 THEN 1 ELSE 0 END) AS short FROM pages_v GROUP BY domain, doc_id) SELECT CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain, count(*) AS docs, sum(pages)::BIGINT AS pages, round(sum(pages)::DOUBLE / count(*), 6) AS pages_per_doc, sum(short)::BIGINT AS short_pages FROM per GROUP BY GROUPING SETS ((), (domain))")
def corpus_stats(spark, d):
    from pagemill.operators.analyses import corpus_stats as stats

    return stats(text_pages(spark, d)).select("domain", "docs", "pages", F.round("pages_per_doc", 6).alias("pages_per_doc"), "short_pages")


@query("""SELECT page_id, length(b) >= length(w) AS by_block, length(b) AS block_chars, md5(CASE WHEN length(b) >= length(w) THEN b ELSE w END) AS text FROM (SELECT page_id, url || chr(10) || page_id::VARCHAR AS b, page_id::VARCHAR || ' ' || url AS w FROM pages)""")
def page_extraction(spark, d):
    """Blocks in reading order against words in reading order, the longer wins (A5b to A5d)."""
    block = lambda y, x, t: F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), t.alias("text"))
    pid = F.col("page_id").cast("string")
    p = table(spark, d, "pages").select("page_id", tx.blocks_text(F.array(block(2.0, 1.0, pid), block(1.0, 5.0, F.lit("  ")), block(1.0, 1.0, F.col("url")))).alias("b"), tx.blocks_text(F.array(block(2.0, 1.0, F.col("url")), block(1.04, 1.0, pid)), "words").alias("w"))
    return p.select("page_id", (F.length("b") >= F.length("w")).alias("by_block"), F.length("b").cast("long").alias("block_chars"), F.md5(tx.longer_text("b", "w")).alias("text"))


@query("SELECT page_id, md5(url || chr(10) || page_id::VARCHAR || ' | ' || url || chr(10) || 'x | y') AS text FROM pages")
def table_aware_text(spark, d):
    pid = F.col("page_id").cast("string")
    tables = F.array(F.array(pid, F.lit("  "), F.col("url")), F.array(F.lit(" ").cast("string")), F.array(F.lit("x "), F.lit(None).cast("string"), F.lit("y")))
    return table(spark, d, "pages").select("page_id", F.md5(tx.with_tables("url", tables)).alias("text"))


@query("""SELECT item_id, sha256('{"item_id":' || item_id::VARCHAR || ',"n":' || length(text)::VARCHAR || '}') AS sha256, sha1('{"item_id":' || item_id::VARCHAR || ',"n":' || length(text)::VARCHAR || '}') AS sha1, printf('%.6f', length(text) / 8.0::DOUBLE) AS fixed FROM benchmark""")
def fingerprints(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.struct("item_id", F.length("text").alias("n")).alias("s"))
    return b.select("item_id", tx.fingerprint(F.col("s"), 256).alias("sha256"), tx.fingerprint(F.col("s")).alias("sha1"), tx.fixed6(F.col("s.n") / 8).alias("fixed"))
