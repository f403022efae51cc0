"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagemill.llm.token_store import tokenize_and_read

    return tokenize_and_read(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.brown_lm import score

    return score(_documents(spark, sf_dir), every_pair=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.chain_dedup import fuzzy_repeats

    return fuzzy_repeats(_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.decontam import contaminated

    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.langid import fit, identify

    docs = _documents(spark, sf_dir)
    return identify(docs, fit(docs))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.quality import judged

    return judged(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.hard_negatives import hard_negatives

    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.row_pattern import find_matches

    found = find_matches(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


# -- the columns of the operators that SQL can say, from the whole operator, beside their SQL


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).drop("kept")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_brown_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# bit by bit, over the bytes of the decimal number (and its sign)
_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

_SQL = {
    "quality_base": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS j FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d JOIN l USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m""",
    "mixing_targets": rf"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
p AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY 2 * source_size::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s),
v AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size::DOUBLE / weight, source) AS place, (total - capped) / open_weight AS level FROM p),
f AS (SELECT place, level FROM v WHERE level * weight <= 2 * source_size ORDER BY place LIMIT 1)
SELECT d.doc_id, d.size, v.source_size, round(CASE WHEN v.place < (SELECT place FROM f) THEN 2 * v.source_size::DOUBLE ELSE v.weight * (SELECT level FROM f) END, 4) AS target FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source""",
    "language_model_base": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
h AS (SELECT r, doc_id, ws, coalesce({_CRC32} % 7 = 2, false) AS held_out FROM d),
t AS (SELECT r, held_out, unnest(ws) AS w FROM h UNION ALL SELECT r, held_out, chr(0) || 'end' FROM h),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
b AS (SELECT r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1)::DOUBLE / ((SELECT n FROM n) + (SELECT v FROM n) + 1))) AS base FROM t LEFT JOIN c USING (w) GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM n) AS train_tokens, round(base, 4) AS base_score FROM h JOIN b USING (r)""",
    "op11_hard_negatives": """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op12_row_pattern": """WITH RECURSIVE d AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT client_id, click_id, epoch_us(ts) AS t, kind, CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT END AS c, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS r FROM d),
g AS (SELECT *, coalesce(t - lag(t) OVER w <= 900000000, false) AND c IS NOT NULL AS near, lag(c) OVER w AS pc, count(*) OVER (PARTITION BY client_id) AS n FROM b WINDOW w AS (PARTITION BY client_id ORDER BY r)),
f AS (SELECT *, near AND coalesce(kind = 'view', false) AS peak, near AND coalesce(kind <> 'error' AND c < pc, false) AS down, near AND coalesce(kind <> 'error' AND c > pc, false) AS up FROM g),
e AS (SELECT *, coalesce(min(CASE WHEN NOT (down OR up) THEN r END) OVER w, n + 1) AS stop, coalesce(min(CASE WHEN NOT down THEN r END) OVER w, n + 1) AS low FROM f WINDOW w AS (PARTITION BY client_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS (SELECT a.client_id, a.r AS s, max_by(b.r, b.r) AS p, max_by(b.low, b.r) - 1 AS z FROM e a JOIN e b ON a.client_id = b.client_id AND b.r > a.r AND b.r <= a.stop AND b.peak AND a.c <= b.c GROUP BY a.client_id, a.r),
n AS (SELECT e.client_id, e.r, min(p.s) OVER (PARTITION BY e.client_id ORDER BY e.r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM e LEFT JOIN p ON p.client_id = e.client_id AND p.s = e.r),
w AS (SELECT client_id, s, 1 AS match_no FROM n WHERE r = 1 AND s IS NOT NULL UNION ALL SELECT w.client_id, n.s, match_no + 1 FROM w JOIN p USING (client_id, s) JOIN n ON n.client_id = w.client_id AND n.r = p.z WHERE n.s IS NOT NULL)
SELECT w.client_id, match_no::BIGINT AS match_no, min_by(e.click_id, e.r) AS first_id, max_by(e.click_id, e.r) AS last_id, count(*) AS n_rows, sum(e.c)::BIGINT AS sum_cents, sha256(string_agg(CASE WHEN e.r = s THEN 'A' WHEN e.r = p THEN 'P' WHEN down THEN 'D' ELSE 'U' END, '' ORDER BY e.r)) AS labels_sha256
FROM w JOIN p USING (client_id, s) JOIN e ON e.client_id = w.client_id AND e.r BETWEEN s AND z GROUP BY w.client_id, match_no""",
    "op13_minhash": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END)) AS shingles FROM d),
k AS (SELECT *, dense_rank() OVER (ORDER BY shingles) AS k FROM g),
s AS (SELECT DISTINCT k, len(shingles) AS n, unnest(shingles) AS w FROM k),
p AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.w = b.w AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT k, min(doc_id) AS low FROM k GROUP BY k),
t AS (SELECT k AS a, k AS b FROM l UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a),
c AS (SELECT t.a AS k, min(low) AS component_id FROM t JOIN l ON l.k = t.b GROUP BY t.a),
o AS (SELECT doc_id, len(shingles) AS n_shingles, CASE WHEN len(shingles) = 0 THEN doc_id ELSE component_id END AS component_id FROM k JOIN c USING (k))
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_store, op3_brown_lm, op4_mixing, op5_chain_dedup, op6_decontamination, op7_language_id, op8_html_extract, op9_quality_rules, op10_simhash, op11_hard_negatives, op12_row_pattern, op13_minhash, quality_base, mixing_targets, language_model_base)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can say; other operator results are held against brute force in the tests."""
    return dict(_SQL)
