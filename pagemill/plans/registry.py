"""Registration of queries with their SQL, and the views over the driver tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query; ``sql`` is DuckDB SQL with the same result, None where SQL cannot express it."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- vectors: a label is a document, a vector a page; the query set is every row whose id is divisible by 100


def vec_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("page_num"), F.col("embedding").cast("array<double>").alias("emb"))


def vec_queries(spark: SparkSession, d: str) -> DataFrame:
    return vec_pages(spark, d).where("page_num % 100 = 0").select(F.col("page_num").alias("qid"), F.col("doc_id").alias("truth"), "emb")


def vec_meta(spark: SparkSession, d: str) -> DataFrame:
    return vec_pages(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


VEC = """v AS (SELECT label::BIGINT AS doc_id, vec_id AS page_num, embedding::DOUBLE[] AS emb FROM embeddings),
q AS (SELECT page_num AS qid, doc_id AS truth, emb FROM v WHERE page_num % 100 = 0),
meta AS (SELECT doc_id, count(*) AS n_pages FROM v GROUP BY doc_id)"""


def dense_sql(k: int = 20) -> str:
    return f"""{VEC},
dense_all AS (SELECT q.qid, v.doc_id, v.page_num, list_dot_product(q.emb, v.emb) AS score FROM q JOIN v ON v.page_num <> q.qid),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, page_num) AS rank FROM dense_all) WHERE rank <= {k})"""


DOCS = """docs AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY first_rank) AS rank FROM
(SELECT qid, doc_id, min(rank) AS first_rank, arg_min(score, rank) AS score FROM dense GROUP BY qid, doc_id))"""

# -- labelled questions and two runs over them, one question per vector


def _letter(n):
    return F.element_at(F.array(*map(F.lit, "ABCDEF")), (n % 6 + 1).cast("int"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    size = 10 + F.col("label") * 7
    return e.select(F.col("vec_id").cast("string").alias("Question_ID"), F.concat(F.lit("domain_"), (F.col("label") % 2 + 1).cast("string")).alias("Domain"), size.cast("string").alias("N_Pages"), _letter(F.col("vec_id")).alias("Correct_Answer"), F.col("label").cast("string").alias("Doc_ID"), (F.col("vec_id") % size + 1).cast("string").alias("Page_Num"))


def run_predictions(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    v, size = F.col("vec_id"), 10 + F.col("label") * 7
    return e.select(v.cast("string").alias("Question_ID"), _letter(v + F.when(v % (3 + k) == 0, 1).otherwise(0)).alias("Correct_Answer"), (F.col("label") + F.when(v % (7 + k) == 0, 1).otherwise(0)).cast("string").alias("Doc_ID"), F.greatest(F.lit(1), v % size + 1 + F.when(v % (2 + k) == 0, v % 5 - 2).otherwise(0)).cast("string").alias("Page_Num"))


TRUTH = """truth AS (SELECT vec_id::VARCHAR AS Question_ID, 'domain_' || (label % 2 + 1)::VARCHAR AS Domain, 10 + label * 7 AS n_pages, substr('ABCDEF', (vec_id % 6 + 1)::INTEGER, 1) AS true_answer, label::VARCHAR AS true_doc, vec_id % (10 + label * 7) + 1 AS true_page FROM embeddings)"""


def run_sql(name: str, k: int) -> str:
    return f"""{name}_p AS (SELECT vec_id::VARCHAR AS Question_ID, substr('ABCDEF', ((vec_id + CASE WHEN vec_id % {3 + k} = 0 THEN 1 ELSE 0 END) % 6 + 1)::INTEGER, 1) AS pred_answer, (label + CASE WHEN vec_id % {7 + k} = 0 THEN 1 ELSE 0 END)::VARCHAR AS pred_doc, greatest(1, vec_id % (10 + label * 7) + 1 + CASE WHEN vec_id % {2 + k} = 0 THEN vec_id % 5 - 2 ELSE 0 END) AS pred_page FROM embeddings),
{name} AS (SELECT *, 0.5::DOUBLE * answer_correct + 0.25::DOUBLE * doc_correct + 0.25::DOUBLE * page_proximity AS score FROM (SELECT t.*, p.pred_answer, p.pred_doc, p.pred_page, CASE WHEN true_answer = pred_answer THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answer_correct, CASE WHEN true_doc = pred_doc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS doc_correct, CASE WHEN true_doc = pred_doc THEN greatest(0.0::DOUBLE, 1 - abs(pred_page - true_page)::DOUBLE / greatest(n_pages, 1)) ELSE 0.0::DOUBLE END AS page_proximity FROM truth t JOIN {name}_p p USING (Question_ID)))"""


# -- text


STRIP_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {STRIP_CHARS})"


def lines_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as pages."""
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", "domain", (F.col("pos") + 1).cast("long").alias("page_num"), "text")


TEXT_PAGES = "pages_v AS (SELECT doc_id, lang AS domain, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page_num, unnest(string_split(text, chr(10))) AS text FROM documents)"


def turn_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as pages."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), "text", "role")


TURN_PAGES = "turns AS (SELECT conv_id AS doc_id, turn + 1 AS page_num, text, role FROM conversations)"
