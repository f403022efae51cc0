"""Configurations, contracts, whole plans, files and the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import CHAT_SYSTEM
from pagemill.plans import config, planner
from pagemill.plans.q_plans import questions
from pagemill.plans.registry import text_pages
from pagemill.sources import files
from pagemill.streaming.governor import govern


def test_inheritance():
    assert len(config.PRESETS) == 35
    c = config.resolve("candidate_runtime_guard_v1", {"llm": {"vote_margin": 0.2}})
    assert (c["name"], c["llm"]["base_passes"], c["llm"]["vote_margin"], c["runtime"]["enable_runtime_governor"]) == ("candidate_runtime_guard_v1", 1, 0.2, True)
    assert c["rerank"]["model_preference"] == ["qwen3_0_6b", "bge"]
    assert config.resolve("candidate_lapalm_v1")["contracts"]["require_gguf_filename"] is None
    assert config.PRESETS["base_local"]["llm"]["vote_margin"] == 0.08
    with pytest.raises(KeyError):
        config.resolve("no such")


def test_contracts():
    c = config.resolve("v7_baseline")
    with pytest.raises(config.ContractError):
        config.check_contracts(c, "bge")
    assert config.check_contracts(config.resolve("v8_quality_branch"), "bge") == ["reranker: qwen3_4b -> bge"]
    with pytest.raises(config.ContractError):
        config.check_contracts(config.resolve("candidate_hybrid_rrf_v1"), "qwen3_0_6b", c["contracts"]["require_gguf_filename"], 8192, bm25=False)


@pytest.fixture(scope="module")
def inputs(spark, small):
    return questions(spark, small).where("qid < 3"), text_pages(spark, small).where("doc_id < 6").select("doc_id", "page_num", "text")


@pytest.mark.parametrize("name", sorted(config.PRESETS))
def test_every_configuration_plans(spark, inputs, name):
    plan = planner.build(config.resolve(name), *inputs)
    assert plan.predictions.columns == ["Question_ID", "Correct_Answer", "Doc_ID", "Page_Num"]


@pytest.mark.parametrize("name", ["v7_baseline", "v8_quality_branch", "v9_regression", "candidate_avir_threshold_v1", "candidate_page_summary_selector_v1", "candidate_ddl_v3_exhaustive"])
def test_configurations_run(spark, inputs, name):
    rows = planner.build(config.resolve(name), *inputs).predictions.collect()
    assert sorted(r.Question_ID for r in rows) == ["0", "1", "2"]
    assert all(r.Correct_Answer in "ABCDEF" and r.Doc_ID and int(r.Page_Num) >= 1 for r in rows)


def test_settings_change_the_plan(spark, inputs):
    """Configurations that differ in one setting from their parent differ in what they ask of the models."""
    asks, pages = inputs
    built = lambda name, over=None, given=pages, **more: planner.build(config.resolve(name, over), asks, given, **more)
    base = built("v7_baseline")
    refocus, chat, parent = built("candidate_v5_refocus_v1"), built("candidate_chat_template_v1"), built("candidate_dense_doc_lock_v3")
    first = base.requests.where("qid = 0 and pass_no = 1").first()
    again = refocus.requests.where("qid = 0 and pass_no = 1").first()
    assert first.prompt != again.prompt and again.prompt.count(asks.where("qid = 0").first().question) == 2
    assert {r.system for r in parent.requests.collect()} == {None} and {(r.system, r.max_tokens) for r in chat.requests.collect()} == {(CHAT_SYSTEM, 4)}
    assert {(r.pass_no, r.temperature) for r in base.requests.collect()} == {(1, 0.0), (2, 0.5), (3, 0.5)}
    assert {r.temperature for r in built("v7_baseline", {"llm": {"vote_temp": 0.9}}).requests.where("pass_no > 1").collect()} == {0.9}
    assert built("candidate_lapalm_v1").models["llm"] == "lapalm" and parent.models["llm"] == "default"


def test_extraction_modes(spark, inputs):
    asks, pages = inputs
    block = "array(struct(10.0D as x, 20.0D as y, 'below ' || text as text), struct(5.0D as x, 1.0D as y, 'above' as text))"
    rich = pages.selectExpr("*", f"{block} as blocks", "array(array('cell one', null, ' two ')) as tables", "array(struct(1.0D as x, 1.0D as y, 'word' as text)) as words")
    events: list = []
    of = lambda mode, tables, given=rich: planner.page_texts(given, {"mode": mode, "table_aware": tables}, events).where("page_num = 1 and doc_id = 1").first().text
    raw = of("raw", False)
    assert of("blocks", False).split("\n")[0] == "above" and of("blocks", True).endswith("cell one | two") and of("words", False) == "word" and of("blocks_plus_words", False) == of("blocks", False)
    assert not events and of("blocks", True, pages) == raw and events == ["extraction: blocks -> raw", "extraction: tables -> none"]
    assert planner.build(config.resolve("candidate_extraction_blocks_v1"), asks, pages).events == events
    plans = [planner.build(config.resolve(n), asks, rich).contexts.where("qid = 0").first().context for n in ("v7_baseline", "candidate_extraction_blocks_v1")]
    assert plans[0] != plans[1] and "cell one | two" in plans[1]


def test_governor_in_a_plan(spark, inputs):
    asks, pages = inputs
    slow = spark.createDataFrame([(0, 9000.0), (1, 9000.0), (2, 9000.0)], "qid long, seconds double")
    over = {"runtime": {"fast_mode_warmup_q": 1, "time_budget_hours": 1.0, "fast_context_pages_cap": 1, "fast_max_chars_per_page_cap": 40}, "llm": {"base_passes": 2, "hard_passes": 3}}
    plan = planner.build(config.resolve("candidate_runtime_guard_v1", over), asks, pages, timings=slow)
    calm = planner.build(config.resolve("candidate_runtime_guard_v1", over), asks, pages)
    n = lambda p: {r.qid: r.n for r in p.votes.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    size = lambda p: {r.qid: len(r.context) for r in p.contexts.collect()}
    assert n(plan)[0] == n(calm)[0] >= 2 and n(plan)[1] == n(plan)[2] == 1 < n(calm)[1]
    assert size(plan)[0] == size(calm)[0] and all(size(plan)[q] <= 60 < size(calm)[q] for q in (1, 2))
    again = {"page_selection": {"strategy": "locked_top_doc_all_pages", "stage2_mode": "always"}}
    assert planner.build(config.resolve("candidate_runtime_guard_v1", over | again), asks, pages, timings=slow).predictions.count() == 3
    plan.release()


def test_votes_on_two_contexts(spark, inputs):
    plan = planner.build(config.resolve("v7_baseline", {"llm": {"dual_context_passes": 2, "top_k_context": 1}}), *inputs)
    votes = {r.qid: r.n for r in plan.votes.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert set(votes.values()) <= {3, 5} and 5 in votes.values()
    assert plan.requests.count() == sum(votes.values())


def test_reranker_ladder(spark, inputs):
    from pagemill.operators import rank

    c = config.resolve("candidate_stronger_reranker_v1")
    built = lambda there, strict=False, preset=c: planner.build(preset, *inputs, rerankers={m: rank.overlap_score for m in there}, strict=strict)
    assert built(["bge", "qwen3_4b"]).models["reranker"] == "qwen3_4b" and not built(["bge", "qwen3_4b"]).events
    assert (built(["bge"]).models["reranker"], built(["bge"]).events) == ("bge", ["reranker: qwen3_4b -> bge"])
    none = built([])
    assert none.models["reranker"] is None and none.rankings["pages"] is none.rankings["candidates"] and none.predictions.count() == 3
    with pytest.raises(config.ContractError):
        built(["bge"], True)
    loose = config.resolve("v8_quality_branch")
    assert built(["bge"], True, loose).events == ["reranker: qwen3_4b -> bge"]


def test_page_summary_under_an_encoder(spark, inputs):
    from pagemill.functions.text import page_summary, with_page_summary
    from pagemill.plans.models import hashed_encoder

    pages = inputs[1]
    for _ in range(10):
        found = with_page_summary(pages)
        assert found.select(hashed_encoder(F.col("summary"))).count() == pages.count()
    assert found.where(~F.col("summary").eqNullSafe(page_summary("text", "page_num"))).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted"\nline', None), ("2", "b,c", "x")], "Question_ID string, Question string, A string")
    files.write_csv(df, str(tmp_path / "q.csv"))
    back = files.read_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [tuple(r) for r in back] == [("1", 'a "quoted"\nline', None), ("2", "b,c", "x")]
    files.write_csv(df.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == ""


def test_first_questions_in_file_order(spark, tmp_path):
    columns = "Question_ID,Domain,N_Pages,Question,A,B,C,D,E,F,Correct_Answer,Doc_ID,Page_Num"
    (tmp_path / "q.csv").write_text(columns + "\n" + "\n".join(f'{900 - i},d,1,"two\nlines",a,b,c,d,e,f,A,x,1' for i in range(300)))
    assert [r.Question_ID for r in files.read_questions(spark, str(tmp_path / "q.csv"), 5).collect()] == ["900", "899", "898", "897", "896"]


def test_split_files(spark, tmp_path):
    from pagemill.operators import splits

    rows = [(str(100 * i + j), f"domain_{i % 2 + 1}", str(3 + 5 * i), f"doc{i:02d}", str(j + 1)) for i in range(14) for j in range(3 + i % 3)]
    q = spark.createDataFrame(rows, "Question_ID string, Domain string, N_Pages string, Doc_ID string, Page_Num string")
    docs = splits.doc_records(q)
    info = files.write_split_files(q, docs, splits.protocol(docs).cache(), str(tmp_path))
    of = lambda name: {r.Question_ID for r in files.read_csv(spark, str(tmp_path / f"{name}.csv")).collect()}
    everything = {r[0] for r in rows}
    lockbox = of("lockbox")
    assert of("train") | of("val") | lockbox == everything and not of("train") & of("val")
    for k in range(5):
        assert of(f"fold_{k}_train") | of(f"fold_{k}_val") == everything - lockbox and not of(f"fold_{k}_train") & of(f"fold_{k}_val")
    assert of("lodo_val_domain_1") == of("lodo_train_no_domain_2") and of("lodo_val_domain_1") | of("lodo_val_domain_2") == everything - lockbox
    assert json.loads((tmp_path / "split_info.json").read_text()) == json.loads(json.dumps(info))
    folds = json.loads((tmp_path / "folds.json").read_text())["folds"]
    assert sorted(x for f in folds for x in f["val_doc_ids"]) == sorted({r[3] for r in rows} - set(json.loads((tmp_path / "lockbox.json").read_text())["doc_ids"]))


def test_evaluation_files_and_timings(spark, tmp_path):
    df = spark.createDataFrame([("all", 2, 1.0, 0.5, 0.25, 0.6875), ("d", 2, 1.0, 0.5, 0.25, 0.6875)], "scope string, n long, answer double, doc double, page double, composite double")
    text = files.write_evaluation(df, str(tmp_path))
    assert json.loads((tmp_path / "evaluation.json").read_text())["all"]["doc"] == 0.5 and (tmp_path / "evaluation.txt").read_text() == text + "\n"
    clock = files.Timings()
    with clock("a"), clock("b"):
        pass
    assert set(clock.as_dict()) == {"a", "b", "total"}


def test_json_validity(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{k",), (None,), ("[1, 2]",)], "props string")
    assert [r.valid for r in df.selectExpr("try_parse_json(props) is not null as valid").collect()] == [True, False, False, True]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()) == [1, 2]


def test_page_files(spark, tmp_path):
    (tmp_path / "dom").mkdir()
    (tmp_path / "dom" / "b.pdf").write_bytes(b"one\fTwo")
    rows = files.read_page_files(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()
    assert [tuple(r) for r in rows] == [("b.pdf", "dom", 1, "one"), ("b.pdf", "dom", 2, "Two")]


def test_split_resolution(tmp_path):
    (tmp_path / "fold_2_val.csv").write_text("x")
    assert files.resolve_split(str(tmp_path), "fold_2").endswith("fold_2_val.csv")
    assert files.resolve_split(str(tmp_path), "val", 2).endswith("fold_2_val.csv")
    with pytest.raises(FileNotFoundError, match="tried"):
        files.resolve_split(str(tmp_path), "lockbox")


def test_paths_and_manifest(tmp_path):
    assert files.output_dir("o", "p", "val", 1, 42, 3).endswith("p__val__fold-1__seed-42__repeat-03")
    m = files.run_manifest(config.resolve("v7_baseline"), ["1", "2"], 42)
    assert m == files.run_manifest(config.resolve("v7_baseline"), ["1", "2"], 42)
    assert m["config_sha1"] != files.run_manifest(config.resolve("v8_quality_branch"), ["1", "2"], 42)["config_sha1"]
    files.write_json({"ї": 1}, str(tmp_path / "a" / "m.json"))
    assert json.loads((tmp_path / "a" / "m.json").read_text()) == {"ї": 1}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.gguf").write_text("")
    assert files.find_model(str(tmp_path)).endswith("x.gguf")


def test_bundle(spark, tmp_path):
    p = spark.createDataFrame([("1", "A", "d", "2")], "Question_ID string, Correct_Answer string, Doc_ID string, Page_Num string")
    r = spark.createDataFrame([(1, "d", 1, 0.5, 1), (1, "e", 2, 0.4, 2)], "qid int, doc_id string, page_num int, score double, rank int")
    files.write_bundle(str(tmp_path), p, p, files.serialize_pages(r, 1), {"a": 1}, {}, {})
    assert files.serialize_docs(r).first().docs[1].doc_id == "e"
    assert (tmp_path / "predictions.csv").exists() and (tmp_path / "run_manifest.json").exists()
    assert spark.read.json(str(tmp_path / "ranking_details.jsonl")).first().pages[0].doc_id == "d"


def test_streaming_governor(spark, tmp_path):
    steps = spark.createDataFrame([("r", i, float(120)) for i in range(1, 41)], "run string, event_id long, seconds double").withColumn("ts", F.timestamp_seconds("event_id"))
    steps.select("run", "ts", "event_id", "seconds").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, ts timestamp, event_id long, seconds double").parquet(str(tmp_path / "in"))
    q = govern(stream, 461).writeStream.format("memory").queryName("governed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("governed").orderBy("done").collect()
    assert [r.done for r in rows if r.fast][0] == 25 and len(rows) == 40


def test_steps_of_a_plan_are_written_once_and_removed(spark, inputs):
    plan = planner.build(config.resolve("v7_baseline"), *inputs)
    # the page texts and vectors are read from files: no window over all pages, no encoder, is left in the predictions' plan but that of the questions
    text = plan.predictions._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in text and text.count("encode(") <= 2
    assert len(plan.predictions.collect()) == inputs[0].count()
    assert plan.kept and all(os.path.exists(p) for p in plan.kept)
    plan.release()
    assert not any(os.path.exists(p) for p in plan.kept)
