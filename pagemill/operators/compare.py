"""Comparison of runs, predictions and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("dense_doc", "final_doc", "dense_page", "final_page")


def run_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """L1: questions of both runs (``score_questions`` rows) with their change."""
    fields = ("pred_answer", "pred_doc", "pred_page", "score")
    a = left.select("Question_ID", "Domain", *[F.col(c).alias(f"left_{c}") for c in fields])
    b = right.select("Question_ID", *[F.col(c).alias(f"right_{c}") for c in fields])
    delta = F.round(F.col("right_score") - F.col("left_score"), 9)
    status = F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged")
    changed = [(~F.col(f"left_pred_{c}").eqNullSafe(F.col(f"right_pred_{c}"))).alias(f"{c}_changed") for c in ("answer", "doc", "page")]
    return a.join(b, "Question_ID").select("*", delta.alias("delta"), status.alias("status"), *changed)


def run_diff_summary(diff: DataFrame) -> DataFrame:
    """Totals and rates of a run diff, over all and by domain."""
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("improved", "regressed", "unchanged")]
    out = diff.groupingSets([[], [F.col("Domain")]], F.col("Domain")).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), *counts, *[rate(f"{c}_changed") for c in ("answer", "doc", "page")], F.grouping("Domain").alias("g"))
    return out.withColumn("Domain", F.when(F.col("g") == 1, "all").otherwise(F.col("Domain"))).drop("g")


def ir_swings(left: DataFrame, right: DataFrame) -> DataFrame:
    """L2: (stage, fixed, broken, improved, regressed) of the true item's rank in two runs' (qid, stage, rank) rows."""
    pair = left.select("qid", "stage", F.col("rank").alias("a")).join(right.select("qid", "stage", F.col("rank").alias("b")), ["qid", "stage"])
    top_a, top_b = F.coalesce(F.col("a") == 1, F.lit(False)), F.coalesce(F.col("b") == 1, F.lit(False))
    far = F.lit(2**31 - 1)
    a, b = F.coalesce("a", far), F.coalesce("b", far)
    return pair.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(~top_a & top_b).alias("fixed"), F.count_if(top_a & ~top_b).alias("broken"), F.count_if(b < a).alias("improved"), F.count_if(b > a).alias("regressed"))


def same_doc_swings(left: DataFrame, right: DataFrame) -> DataFrame:
    """L2: (improved, regressed): questions whose document both runs (scored questions) have right and whose page came nearer or went further."""
    pair = left.where("doc_correct = 1").select("Question_ID", F.col("page_proximity").alias("a")).join(right.where("doc_correct = 1").select("Question_ID", F.col("page_proximity").alias("b")), "Question_ID")
    return pair.agg(F.count_if(F.col("b") > F.col("a")).alias("improved"), F.count_if(F.col("b") < F.col("a")).alias("regressed"))


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """L3: (path, left, right, delta) over the union of the paths; delta null where a side is missing."""
    return left.select("path", F.col("value").alias("left")).join(right.select("path", F.col("value").alias("right")), "path", "full").select("path", "left", "right", (F.col("right") - F.col("left")).alias("delta"))


def metric_tree_diff(left: DataFrame, right: DataFrame, name: str = "id", tree: str = "tree") -> DataFrame:
    """L3: (id, path, left, right, delta) of the JSON trees (strings, of any depth) of two runs.

    The trees meet once, side by side as VARIANTs; from there each level opens in place, without a shuffle, for all pairs whose both sides are objects: a row
    for each member that one of them has.  Where one side is no object, or lacks the member, the node itself is the result.  ``left`` and
    ``right`` are the values of numbers (true and false are 1 and 0), else null, and so is their delta.  Text that is not JSON is a tree without members.
    """

    def side(trees: DataFrame, label: str) -> DataFrame:
        return trees.select(F.col(name).cast("string").alias("id"), F.coalesce(F.try_parse_json(F.col(tree)), F.parse_json(F.lit("{}"))).alias(label))

    members = lambda c: F.col(c).try_cast("map<string,variant>")
    level = side(left, "l").join(side(right, "r"), "id", "full").select("id", F.array().cast("array<string>").alias("path"), "l", "r")
    while level.where(members("l").isNotNull() & members("r").isNotNull()).limit(1).count():
        opened = level.withColumns({"a": members("l"), "b": members("r")})
        inner = F.transform(F.array_union(F.map_keys("a"), F.map_keys("b")), lambda k: F.struct(F.concat("path", F.array(k)).alias("path"), F.try_element_at("a", k).alias("l"), F.try_element_at("b", k).alias("r")))
        both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), inner).otherwise(F.array(F.struct("path", "l", "r")))
        level = opened.select("id", F.explode(both).alias("x")).select("id", "x.path", "x.l", "x.r")

    def number(c: str) -> Column:
        kind = F.when(members(c).isNull(), F.schema_of_variant(c))
        return F.when(kind == "BOOLEAN", F.try_variant_get(c, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(c, "$", "double"))

    return level.select("id", F.array_join("path", ".").alias("path"), number("l").alias("left"), number("r").alias("right")).withColumn("delta", F.col("right") - F.col("left"))


def prediction_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """L4: which fields of the predictions of both runs differ."""
    fields = ("Correct_Answer", "Doc_ID", "Page_Num")
    a = left.select("Question_ID", *[F.col(c).alias(f"left_{c}") for c in fields])
    b = right.select("Question_ID", *[F.col(c).alias(f"right_{c}") for c in fields])
    return a.join(b, "Question_ID").select("*", *[(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))).alias(f"{c}_changed") for c in fields])


def prediction_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(common, only_left, only_right, different, match) of two prediction tables."""
    fields = ("Correct_Answer", "Doc_ID", "Page_Num")
    a = left.select("Question_ID", F.struct(*fields).alias("left"))
    b = right.select("Question_ID", F.struct(*fields).alias("right"))
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    out = a.join(b, "Question_ID", "full").agg(F.count_if(both).alias("common"), F.count_if(F.col("right").isNull()).alias("only_left"), F.count_if(F.col("left").isNull()).alias("only_right"), F.count_if(both & ~F.col("left").eqNullSafe(F.col("right"))).alias("different"))
    return out.withColumn("match", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("different") == 0))


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of two (key, value) manifests whose values differ or that one lacks."""
    a, b = left.select("key", F.col("value").alias("left")), right.select("key", F.col("value").alias("right"))
    return a.join(b, "key", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def parity_report(left: DataFrame, right: DataFrame, left_manifest: DataFrame, right_manifest: DataFrame) -> DataFrame:
    """One row: do predictions and manifests of two runs agree."""
    wrong = manifest_diff(left_manifest, right_manifest).agg(F.count(F.lit(1)).alias("manifest_mismatches"))
    return prediction_parity(left, right).crossJoin(wrong).withColumn("manifests_match", F.col("manifest_mismatches") == 0)
