"""Kept vectors (D7, D8): a content-addressed table that a text enters once per encoder.

Layout: ``<path>/encoder=<key>/<batch>/`` with rows (h, emb), h being the SHA-256 of the text.  The encoder's key names everything that its vectors depend
on (model and truncation).  A demand for vectors

1. hashes the demanded texts, and takes out the hashes that the table has (anti-join on the hash alone: no text is moved, no vector read),
2. keeps one text for each hash that is left (in a steady state few: their side of the join is then broadcast at its measured size),
3. encodes these as one Spark job into a batch of its own, which counts once the job has committed,
4. joins the demanded rows with the demanded vectors of the batches that are there.

A table is the list of its batches at the time of the read: two reads in one plan that saw different batches have different paths, so Spark does not
take one for the other.  Two runs that encode the same text at once leave two equal rows; a read takes one of them.  Nothing is ever changed
in place, so a lost executor or driver costs the texts that were not yet committed.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "h binary, emb array<float>"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Texts encoded by the last call, and by all.
        self.encoded, self.total = 0, 0

    def _folder(self, key: str) -> str:
        return f"{self.path}/encoder={re.sub(r'[^A-Za-z0-9._-]', '_', key)}"

    def batches(self, key: str) -> list[str]:
        """The folders of committed batches."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(key))
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = (x.getPath() for x in files.listStatus(folder))
        return sorted(str(p.toString()) for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _rows(self, key: str) -> DataFrame:
        there = self.batches(key)
        return self.spark.read.schema(SCHEMA).parquet(*there) if there else self.spark.createDataFrame([], SCHEMA)

    def table(self, key: str) -> DataFrame:
        """(h, emb) of one encoder, each text once."""
        return self._rows(key).groupBy("h").agg(F.any_value("emb").alias("emb"))

    def embed(self, rows: DataFrame, encoder, text: str = "text") -> DataFrame:
        """``rows`` without ``text`` and with ``emb``; texts that the table lacks are encoded now, each once. Null texts count as empty."""
        key = getattr(encoder, "key", getattr(encoder, "__name__", type(encoder).__name__))
        keyed = rows.withColumn(text, F.coalesce(text, F.lit(""))).withColumn("_h", F.unhex(F.sha2(text, 256)))
        demanded = keyed.select(F.col("_h").alias("h")).distinct()
        # hashes first: of what the table has, no text is moved
        missing = demanded.join(self._rows(key).select("h"), "h", "left_anti")
        wanted = keyed.select(F.col("_h").alias("h"), F.col(text).alias("text")).join(missing, "h", "left_semi").groupBy("h").agg(F.any_value("text").alias("text"))
        batch = f"{self._folder(key)}/{uuid.uuid4().hex}"
        wanted.select("h", encoder(F.col("text")).alias("emb")).write.parquet(batch)
        self.encoded = self.spark.read.schema(SCHEMA).parquet(batch).count()
        self.total += self.encoded
        found = self._rows(key).join(demanded, "h", "left_semi").groupBy("h").agg(F.any_value("emb").alias("emb"))
        return keyed.drop(text).join(found.withColumnRenamed("h", "_h"), "_h").drop("_h")
