"""Models in a plan: worker cache, truncation, pooling, batches, stop sequences; kept vectors; rerankers of a configuration."""

import os
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import rank
from pagemill.plans import config, models, planner, runtime
from pagemill.plans.q_plans import questions
from pagemill.plans.registry import text_pages
from pagemill.sources.vectors import VectorStore


class Fake:
    """A text model over characters: its first state holds the number and the sum of the ids that it sees."""

    bos, eos = 1, 2

    def tokens(self, text):
        return [3 + ord(c) % 90 for c in text]

    def hidden(self, ids, mask):
        assert ids.shape == mask.shape and len(ids) <= 5 and (ids[mask == 0] == 0).all()
        first = np.stack([mask.sum(1), (ids * mask).sum(1), ids[:, 0]], 1)
        return np.stack([first, np.full(first.shape, -1)], 1)

    def logits(self, ids, mask):
        return mask.sum(1).astype(float)

    def complete(self, prompt, system, max_tokens, temperature, stop):
        return {0.0: "B. because C", 0.5: " \n"}.get(temperature, f"{'chat' if system else 'raw'} {max_tokens}")


class YesNo(Fake):
    def logits(self, ids, mask):
        return np.stack([np.zeros(len(ids)), mask.sum(1) / 1000], 1)


def load(folder, kind):
    with open(f"{folder}/loads", "a") as f:
        f.write(f"{os.getpid()}\n")
    return kind()


def test_encoder(spark, tmp_path):
    texts = ["", "a", "abc" * 40, None, "zz", "q" * 7, "b" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    encoder = runtime.TextEncoder("fake-encoder", partial(load, str(tmp_path), Fake), 10, 5)
    assert encoder.sized(20, 4).key == "fake-encoder-20"
    for _ in range(2):
        got = {r.i: r.e for r in rows.select("i", encoder(F.col("t")).alias("e")).collect()}
    for i, t in enumerate(texts):
        ids = [1, *[3 + ord(c) % 90 for c in t or ""][:8], 2]
        want = np.array([len(ids), sum(ids), 1]) / np.linalg.norm([len(ids), sum(ids), 1])
        assert np.allclose(got[i], want, atol=1e-6)
    loads = open(f"{tmp_path}/loads").read().split()
    assert loads and len(loads) == len(set(loads))  # once per worker, whatever the number of tasks


def test_cross_encoders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", "x" * 9000), (2, "q", None), (3, None, "yy")], "i int, q string, t string")
    plain = runtime.CrossEncoder("fake-cross", partial(load, str(tmp_path), Fake), max_length=6000)
    prompted = runtime.CrossEncoder("fake-yes", partial(load, str(tmp_path), YesNo), generative=True, max_length=100_000)
    of = lambda scorer: {r.i: r.s for r in rows.select("i", runtime.for_pages(scorer, 4000)(F.col("q"), F.col("t")).alias("s")).collect()}
    assert of(plain) == {1: 2 + 4000 + 2, 2: 2 + 1 + 1, 3: 2 + 2 + 1}
    logits = {i: -np.log(1 / p - 1) * 1000 for i, p in of(prompted).items()}
    assert round(logits[1] - logits[2]) == 4000 and runtime.for_pages(prompted, 4000) is prompted  # the prompt cuts the document itself
    assert of(plain.sized(7, 2)) == {1: 7, 2: 4, 3: 5}


def test_generator(spark, tmp_path, inputs):
    assert runtime.stopped("B. C", [".", " "]) == "B" and runtime.stopped("x", ["."]) == "x"
    model = runtime.Generator("fake-llm", partial(load, str(tmp_path), Fake))
    plan = planner.build(config.resolve("v7_baseline"), *inputs, answerer=model)
    assert {(r.pass_no, tuple(r.stop)) for r in plan.requests.collect()} == {(i, ("\n", ".")) for i in (1, 2, 3)}
    assert {(r.pass_no, r.letter) for r in plan.votes.collect()} == {(1, "B"), (2, "A"), (3, "A")}
    chat = planner.build(config.resolve("candidate_chat_template_v1"), *inputs, answerer=model)
    assert {tuple(r.stop) for r in chat.requests.collect()} == {("\n", ".", " ")}


@pytest.fixture(scope="module")
def inputs(spark, small):
    return questions(spark, small).where("qid < 3"), text_pages(spark, small).where("doc_id < 9").select("doc_id", "page_num", "text")


def test_store_encodes_a_text_once(spark, tmp_path):
    encoder = runtime.TextEncoder("fake-stored", partial(load, str(tmp_path), Fake), 10, 5)
    store = VectorStore(spark, f"{tmp_path}/vectors")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, None), (3, 1, "")], "doc_id long, page_num long, text string")
    first = {(r.doc_id, r.page_num): r.emb for r in store.embed(rows, encoder).collect()}
    assert store.encoded == 3 and len(first) == 5 and first[1, 1] == first[2, 1] and first[2, 2] == first[3, 1]
    again = store.embed(rows.unionByName(spark.createDataFrame([(9, 9, "new")], rows.schema)), encoder)
    assert store.encoded == 1 and again.count() == 6
    later = VectorStore(spark, f"{tmp_path}/vectors")  # another run
    assert later.embed(rows, encoder).count() == 5 and later.encoded == 0
    later.embed(rows, encoder.sized(3, 5))
    assert later.encoded == 3  # another truncation, other vectors
    # two runs that appended the same text at once
    spark.read.parquet(*later.batches("fake-stored-10")).limit(2).write.parquet(f"{tmp_path}/vectors/encoder=fake-stored-10/again")
    assert later.embed(rows, encoder).count() == 5 and later.encoded == 0
    assert later.embed(rows.limit(0), encoder).count() == 0
    # a batch that was not committed does not count
    spark.createDataFrame([(b"0" * 32, [1.0])], "h binary, emb array<float>").write.parquet(f"{tmp_path}/vectors/encoder=fake-stored-10/torn")
    os.remove(f"{tmp_path}/vectors/encoder=fake-stored-10/torn/_SUCCESS")
    assert not any(b.endswith("torn") for b in later.batches("fake-stored-10"))


def test_reads_of_one_plan_keep_their_own_batches(spark, tmp_path):
    encoder = runtime.TextEncoder("fake-union", partial(load, str(tmp_path), Fake), 10, 5)
    store = VectorStore(spark, f"{tmp_path}/vectors")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id long, page_num long, text string")
    first, second = store.embed(rows.where("doc_id = 1"), encoder), store.embed(rows, encoder)
    assert first.unionByName(second).count() == 5


@pytest.mark.parametrize("name", ["candidate_structure_chunks_v1", "candidate_page_summary_selector_v1"])
def test_plans_with_kept_vectors(spark, tmp_path, inputs, name):
    """The same predictions, nothing encoded twice, and only documents that are asked for."""
    kept = [VectorStore(spark, str(tmp_path)) for _ in range(2)]
    plans = [planner.build(config.resolve(name), *inputs, store=s) for s in (None, *kept)]
    rows = [sorted(map(tuple, p.predictions.collect())) for p in plans]
    assert rows[0] == rows[1] == rows[2]
    assert kept[0].total > 0 and kept[1].total == 0


def test_chunks_of_wanted_documents_only(spark, tmp_path, inputs):
    asks, pages = inputs
    over = {"retrieval": {"structure_doc_topn": 1}}
    totals = []
    for extra in ({}, over):
        store = VectorStore(spark, f"{tmp_path}/{len(totals)}")
        planner.build(config.resolve("candidate_structure_chunks_v1", extra), asks.where("qid = 0"), pages, store=store)
        totals.append(store.total)
    n_pages = pages.select("text").distinct().count()
    assert n_pages * 0.5 < totals[1] < totals[0]


def backwards(question, text):
    return -rank.overlap_score(question, text)


def test_documents_are_ranked_by_the_configured_reranker(spark, inputs):
    over = {"rerank": {"doc_skip_topn": 99}}
    built = lambda name, scorer: planner.build(config.resolve(name, over), *inputs, reranker=scorer)
    order = lambda p: sorted((r.qid, r["rank"], r.doc_id) for r in p.rankings["docs"].collect())
    for name in ("v9_regression", "v7_baseline"):
        assert order(built(name, rank.overlap_score)) != order(built(name, backwards))
    flags = built("v9_regression", backwards).rerank_flags.collect()
    assert len(flags) == 3 and any(r.changed for r in flags) and not any(r.changed and r.skipped for r in flags)
    sure = planner.build(config.resolve("v9_regression", {"rerank": {"doc_skip_topn": 0, "doc_skip_margin": -9.0}}), *inputs, reranker=backwards).rerank_flags.collect()
    assert all(r.skipped and not r.changed for r in sure)


def test_sparse_backend(spark, inputs):
    c = config.resolve("candidate_hybrid_rrf_v1")
    with pytest.raises(config.ContractError):
        planner.build(c, *inputs, sparse_backends=())
    loose = config.resolve("candidate_hybrid_rrf_v1", {"contracts": {"require_bm25_backend": False}})
    plan = planner.build(loose, *inputs, sparse_backends=())
    assert "retrieval: hybrid -> dense only" in plan.events and plan.rankings["candidates"].count()


def test_hashed_encoder_works_on_flat_arrays(spark):
    """Normalised counts of hashed words, by Arrow arrays and not by an object for each row and number."""
    from pyspark.util import PythonEvalType

    texts = ["red red blue", "", None, "  ", "Так 17 так"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(1)
    out = df.select("i", models.hashed_encoder(F.col("text")).alias("emb"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan
    words = {0: ["red", "red", "blue"], 4: ["так", "17", "так"]}
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for ws in words.values() for w in set(ws)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(1 << 31)).alias("h")).collect()}
    for r in out.collect():
        want = np.zeros(models.DIM)
        for w in words.get(r.i, []):
            want[hashed[w] % models.DIM] += 1
        assert np.allclose(r.emb, want / max(np.linalg.norm(want), 1e-12)) and len(r.emb) == models.DIM
