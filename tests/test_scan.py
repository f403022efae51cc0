"""The governor as a distributed scan: one long run beside short ones, dealt over many tasks."""

import random

from pyspark.sql import functions as F

from pagemill.operators import answer


def test_governor_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [("long", i, round(rng.uniform(0, 2) if i != 3000 else 9000.0, 3)) for i in range(5000)] + [(r, i, float(i)) for r in ("a", None) for i in range(40)] + [("quick", i, None if i % 7 == 0 else 0.01) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        steps = spark.createDataFrame(rows, "run string, event_id long, seconds double").repartition(5)
        out = answer.governor(steps, 6000, 10_000.0, 25, order=("event_id",))
        got = {(r.run, r.event_id): r for r in out.collect()}
        # no task of the local windows has more than its range
        n = out.sparkSession.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).where("run = 'long'").groupBy("_block").count().agg(F.max("count"), F.count("*")).first()
        assert n[0] < 5000 / 8 and n[1] > 10
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows)
    latches = {}
    for run, i, seconds in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        done, elapsed, fast = latches.get(run, (0, None, False))
        before, done = fast, done + 1
        elapsed = elapsed if seconds is None else (elapsed or 0.0) + seconds
        projected = None if elapsed is None else elapsed + elapsed / done * max(6000 - done, 0)
        fast = bool(fast or (projected is not None and done >= 25 and round(projected, 6) > 10_000.0))
        latches[run] = done, elapsed, fast
        r = got[run, i]
        assert (r.done, r.fast, r.fast_before) == (done, fast, before)
        assert (r.elapsed is None and elapsed is None) or abs(r.elapsed - elapsed) < 1e-6
    assert got["long", 3000].fast and not got["long", 2999].fast and not got["quick", 299].fast and not got["long", 3000].fast_before
