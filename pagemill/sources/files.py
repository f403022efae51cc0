"""Sources and sinks: schemas are explicit and reads stay lazy."""

from __future__ import annotations

import contextlib
import json
import re
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.schemas import QUESTION
from pagemill.sources.page_files import read_pages, without_events


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A1: quoted fields may hold line breaks and quotes; every column is a string."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def read_questions(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Questions, all or the first in file order."""
    found = read_csv(spark, path, QUESTION)
    if limit <= 0:
        return found
    # a file whose fields may hold line breaks is read by one task, whose running number is its order
    numbered = found.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
    return numbered.orderBy("_file", "_row").limit(limit).drop("_file", "_row")


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A2: one document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A3: one document per line; blank lines are skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_page_files(spark: SparkSession, root: str, parse, pattern: str = "*.pdf") -> DataFrame:
    """A4: one row per page of every file under ``root``: (doc_id: file name, domain: folder, page_num, text); files that break are left out.

    ``parse``: bytes to a list of page texts.  ``page_files.read_pages`` takes parsers that stream, and tells which files broke.
    """
    pages = read_pages(spark, root, lambda file: parse(file.read()), pattern)
    return without_events(pages)[0].select("doc_id", "domain", "page_num", "text")


def resolve_split(root: str, split: str = "full", fold: int | None = None, file: str | None = None) -> str:
    """Explicit file, existing path, CSV name, fold patterns, then the split's own name; the error lists the attempts."""
    base = Path(root)
    tried = [Path(file)] if file else []
    tried += [Path(split), base / split] if not file else [base / file]
    if not split.endswith(".csv") and not file:
        if fold is not None:
            tried += [base / f"fold_{fold}_{split}.csv", base / f"fold{fold}_{split}.csv", base / f"fold_{fold}" / f"{split}.csv"]
        m = re.fullmatch(r"fold[_-]?(\d+)", split)
        if m:
            tried.append(base / f"fold_{m[1]}_val.csv")
        tried.append(base / f"{split}.csv")
    for p in tried:
        if p.is_file():
            return str(p)
    raise FileNotFoundError(f"no file for split {split!r}; tried: " + ", ".join(map(str, tried)))


def first_existing(*paths: str) -> str:
    """The first path that exists, else the first."""
    return next((p for p in paths if Path(p).exists()), paths[0])


def runtime_paths(root: str, kind: str = "local") -> dict[str, str]:
    """A10: where an environment keeps its inputs and outputs."""
    base = Path(root)
    data, out = (base / "input", base / "working") if kind == "kaggle" else (base / "data", base / "outputs")
    return {"questions": str(data / "questions.csv"), "pages": str(data / "pages"), "models": str(data / "models"), "splits": str(data / "splits"), "outputs": str(out)}


def find_model(root: str, name: str | None = None, suffix: str = ".gguf") -> str:
    """A model file, by name where one is required."""
    found = sorted(p for p in Path(root).rglob(f"*{suffix}") if name is None or p.name == name)
    if not found:
        raise FileNotFoundError(f"no {name or suffix} under {root}")
    return str(found[0])


def write_csv(df: DataFrame, path: str) -> None:
    """B1: one CSV with a header, rows streamed through the driver a partition at a time."""
    import csv

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out, empty = csv.writer(f), True
        for row in df.toLocalIterator():
            if empty:
                out.writerow(df.columns)
                empty = False
            out.writerow(["" if x is None else x for x in row])


def write_csv_folder(df: DataFrame, path: str) -> None:
    """B1 at scale: part files written by the executors."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(value, path: str) -> None:
    """B2: a driver-side document."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=True), encoding="utf-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    """B3."""
    df.write.mode("overwrite").json(path)


def serialize_pages(ranking: DataFrame, limit: int | None = None) -> DataFrame:
    """(qid, pages array<struct>) in rank order."""
    kept = ranking if limit is None else ranking.where(F.col("rank") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "page_num", "score")))
    return kept.groupBy("qid").agg(F.transform(listed, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["page_num"].alias("page_num"), x["score"].alias("score"))).alias("pages"))


def serialize_docs(ranking: DataFrame, limit: int | None = None) -> DataFrame:
    """(qid, docs array<struct>) in rank order."""
    kept = ranking if limit is None else ranking.where(F.col("rank") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    return kept.groupBy("qid").agg(F.transform(listed, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("docs"))


def write_bundle(folder: str, predictions: DataFrame, per_question: DataFrame, rankings: DataFrame, summary: dict, timings: dict, manifest: dict, parity: dict | None = None) -> None:
    """All artifacts of a run."""
    write_csv(predictions, f"{folder}/predictions.csv")
    write_csv(per_question, f"{folder}/per_question.csv")
    write_jsonl(rankings, f"{folder}/ranking_details.jsonl")
    for name, value in (("summary", summary), ("timings", timings), ("run_manifest", manifest), ("parity_report", parity or {})):
        write_json(value, f"{folder}/{name}.json")


def write_diff(folder: str, summary: DataFrame, diff: DataFrame) -> None:
    """B5."""
    write_json([r.asDict() for r in summary.collect()], f"{folder}/diff_summary.json")
    write_csv(diff, f"{folder}/question_diff.csv")


def write_splits(questions: DataFrame, assignment: DataFrame, path: str) -> None:
    """Questions partitioned by role and fold, so that a fold is read by partition pruning."""
    joined = questions.join(assignment.withColumnRenamed("doc_id", "Doc_ID"), "Doc_ID")
    joined.write.mode("overwrite").partitionBy("role", "fold").parquet(path)


def write_split_files(questions: DataFrame, docs: DataFrame, assignment: DataFrame, folder: str, seed: int = 42, val_ratio: float = 0.2) -> dict:
    """The CSV files of every split (legacy, lockbox, folds, one domain left out) and the three manifests; returns split_info."""
    from pagemill.operators.splits import leave_one_domain_out, summary

    joined = questions.join(assignment.withColumnRenamed("doc_id", "Doc_ID"), "Doc_ID")
    folds = sorted(r["fold"] for r in assignment.where("role = 'cv'").select("fold").distinct().collect())
    domains = sorted(r["Domain"] for r in questions.select("Domain").distinct().collect())
    cv, held = joined.where("role = 'cv'"), leave_one_domain_out(questions.join(joined.where("role = 'cv'").select("Question_ID"), "Question_ID", "left_semi"))
    files = {"train": joined.where("legacy = 'train'"), "val": joined.where("legacy = 'val'"), "lockbox": joined.where("role = 'lockbox'")}
    for k in folds:
        files |= {f"fold_{k}_train": cv.where(F.col("fold") != k), f"fold_{k}_val": cv.where(F.col("fold") == k)}
    for name in domains:
        for role, file in (("train", f"lodo_train_no_{name}"), ("val", f"lodo_val_{name}")):
            files[file] = questions.join(held.where((F.col("held_out") == name) & (F.col("role") == role)).select("Question_ID"), "Question_ID", "left_semi")
    for name, rows in files.items():
        write_csv(rows.select(*questions.columns), f"{folder}/{name}.csv")

    def about(part: DataFrame) -> dict:
        rows = [r.asDict() for r in summary(docs, part).collect()]
        count = lambda key: {k: sum(r["n_docs"] for r in rows if r[key] == k) for k in sorted({r[key] for r in rows})}
        return {"doc_count": sum(r["n_docs"] for r in rows), "question_count": sum(r["n_questions"] for r in rows), "doc_ids": sorted(r["doc_id"] for r in part.collect()), "domain_counts": count("domain"), "length_bucket_counts": count("length_bucket")}

    locked = about(assignment.where("role = 'lockbox'"))
    manifest = [{"fold_index": k, "train_doc_ids": (a := about(assignment.where(f"role = 'cv' and fold <> {k}")))["doc_ids"], "val_doc_ids": (b := about(assignment.where(f"role = 'cv' and fold = {k}")))["doc_ids"], "train_summary": a, "val_summary": b} for k in folds]
    lockbox = {"doc_ids": locked["doc_ids"], "summary": {"question_count": locked["question_count"], "doc_count": locked["doc_count"], "domain_counts": locked["domain_counts"], "bucket_counts": locked["length_bucket_counts"]}}
    lodo = {r["held_out"]: {"train": r["train"], "val": r["val"]} for r in held.groupBy("held_out").agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "val").alias("val")).collect()}
    by_domain = {role: {r["Domain"]: r["n"] for r in files[role].groupBy("Domain").agg(F.count(F.lit(1)).alias("n")).collect()} for role in ("train", "val")}
    info = {"seed": seed, "val_ratio": val_ratio, "standard": {**{role: sum(by_domain[role].values()) for role in by_domain}, **{f"{role}_by_domain": by_domain[role] for role in by_domain}}, "protocol": {"folds": manifest, "lockbox": lockbox, "lodo": lodo}, "lodo": lodo}
    for name, value in (("split_info", info), ("folds", {"folds": manifest}), ("lockbox", lockbox)):
        write_json(value, f"{folder}/{name}.json")
    return info


def write_evaluation(evaluated: DataFrame, folder: str, name: str = "evaluation") -> str:
    """The averages by scope as JSON and as the text report, which is returned."""
    from pagemill.operators.metrics import report

    rows = {r["scope"]: {k: v for k, v in r.asDict().items() if k != "scope"} for r in evaluated.collect()}
    write_json(rows, f"{folder}/{name}.json")
    text = report(evaluated)
    Path(f"{folder}/{name}.txt").write_text(text + "\n", encoding="utf-8")
    return text


class Timings:
    """Seconds of each stage of a run, for the artifact bundle; ``with timings("retrieval"): ...``."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextlib.contextmanager
    def __call__(self, stage: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[stage] = self.seconds.get(stage, 0.0) + time.monotonic() - began

    def as_dict(self) -> dict[str, float]:
        return {**{k: round(v, 6) for k, v in self.seconds.items()}, "total": round(sum(self.seconds.values()), 6)}


def output_dir(root: str, preset: str, split: str, fold: int | None = None, seed: int | None = None, repeat: int | None = None) -> str:
    """Folder name of a repeat."""
    parts = [preset, split] + [f"{k}-{v}" if k != "repeat" else f"repeat-{v:02d}" for k, v in (("fold", fold), ("seed", seed), ("repeat", repeat)) if v is not None]
    return str(Path(root) / "__".join(parts))


def run_manifest(config: dict, questions: list[str], seed: int | None = None, repeat: int | None = None, events: list[str] | None = None) -> dict:
    """What a run depended on, with fingerprints over stable JSON."""
    import hashlib
    import platform

    stable = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return {"config": config.get("name"), "config_sha1": hashlib.sha1(stable(config).encode()).hexdigest(), "questions_sha256": hashlib.sha256(stable(questions).encode()).hexdigest(), "n_questions": len(questions), "seed": seed, "repeat": repeat, "fallback_events": events or [], "python": platform.python_version(), "machine": platform.machine()}
