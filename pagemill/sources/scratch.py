"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the warehouse, or on a local master a temporary folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        alone = context.master.split("[")[0] == "local"
        found = (tempfile.gettempdir() if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")) + "/pagemill-shared"
    return found.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/pagemill-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written[path] = spark
    return path


def remove_written(paths: list[str] | None = None) -> None:
    """Removes these paths, or all that were given out."""
    for path, spark in [(p, s) for p, s in _written.items() if paths is None or p in paths]:
        with contextlib.suppress(Exception):  # the cluster may have ended before
            if spark.sparkContext._jsc is not None:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.pop(path, None)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table: cuts lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
