"""Session factory: UTC, adaptive execution, shuffle partitions that AQE coalesces to the data."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pagemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bounds of an Arrow batch: whole texts and vectors can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch bounds; plans are read after the call, so the setting stays."""
    for key, value in BATCH.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, where they would not find it by PYTHONPATH or their working folder."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    root = package.parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in places) or getattr(context, "_pagemill_shipped", False):
        return
    path = f"{tempfile.mkdtemp()}/pagemill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    context.addPyFile(path)  # Spark's own file service brings it to every executor
    context._pagemill_shipped = True
