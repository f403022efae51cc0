"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  The runner writes what a stage returns as Parquet and
hands it, read again, to the next one, so a lost executor never costs more than the stage it hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import saved
from pagemill.llm.decontam import clean_documents
from pagemill.llm.mixing import mixed_documents
from pagemill.llm.quality import quality_filter
from pagemill.llm.simhash import keep_one
from pagemill.llm.token_store import tokenize_and_read

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None
#: The vocabulary of the token output; a parameter, never copied.
TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality rules reject go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that leak a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the token store, read back: one row for each document of the mix."""
    import public_tokenizers

    return tokenize_and_read(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
