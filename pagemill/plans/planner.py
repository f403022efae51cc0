"""From a configuration to one DataFrame plan: questions and pages in, predictions and diagnostics out.

The order of the steps is part of the semantics (SURVEY 3.1): candidates, lock,
document ranking, governor, context, margins, passes, votes, page.  Whatever a
configuration switches off is not planned at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import CHAT_SYSTEM, OPTION_LETTERS, blocks_text, longer_text, prompt, structure_chunks, with_page_summary, with_tables
from pagemill.operators import answer as an
from pagemill.operators import locate, postings, rank, retrieve
from pagemill.plans import models
from pagemill.plans.config import ContractError, check_contracts
from pagemill.plans.runtime import for_pages
from pagemill.session import bounded_batches
from pagemill.sources.scratch import remove_written, scratch_path, written
from pagemill.sources.vectors import VectorStore

#: Where an answer ends.
STOPS, CHAT_STOPS = ("\n", "."), ("\n", ".", " ")


@dataclass
class Plan:
    predictions: DataFrame
    rankings: dict[str, DataFrame]
    contexts: DataFrame
    votes: DataFrame
    requests: DataFrame
    events: list[str] = field(default_factory=list)
    models: dict[str, str | None] = field(default_factory=dict)
    rerank_flags: DataFrame | None = None
    kept: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Removes what the plan has written on its way, once its results are written."""
        remove_written(self.kept)


def page_texts(pages: DataFrame, extraction: dict, events: list[str]) -> DataFrame:
    """A5 to A5e: (doc_id, page_num, text) by the extraction mode.

    Pages may bring ``blocks`` and ``words`` (arrays of x, y, text) and ``tables`` (arrays of rows of cells); a mode whose columns
    are missing falls back to the raw text, with an event.
    """
    mode, there = extraction["mode"], set(pages.columns)
    needs = {"raw": set(), "blocks": {"blocks"}, "words": {"words"}, "blocks_plus_words": {"blocks", "words"}}[mode]
    text: Column = F.col("text")
    if needs - there:
        events.append(f"extraction: {mode} -> raw")
    elif mode == "blocks":
        text = blocks_text("blocks")
    elif mode == "words":
        text = blocks_text("words", "words")
    elif mode == "blocks_plus_words":
        text = longer_text(blocks_text("blocks"), blocks_text("words", "words"))
    out = pages.withColumn("text", text)
    if extraction["table_aware"]:
        if "tables" in there:
            out = out.withColumn("text", with_tables("text", "tables"))
        else:
            events.append("extraction: tables -> none")
    return out.select("doc_id", "page_num", "text")


def pick_reranker(config: dict, rerankers: dict, events: list[str], strict: bool) -> str | None:
    """The first model of the ladder that is there; contracts are checked if ``strict``."""
    ladder = config["rerank"]["model_preference"]
    found = next((m for m in ladder if m in rerankers), None)
    if strict:
        need = config["contracts"]
        events += check_contracts(config, found, need["require_gguf_filename"], need["require_n_ctx"])
        if found is None and need["require_reranker"]:
            raise ContractError(f"require_reranker: {need['require_reranker']} wanted, none found")
    elif ladder and found != ladder[0]:
        events.append(f"reranker: {ladder[0]} -> {found}")
    return found


def fast_flags(config: dict, questions: DataFrame, timings: DataFrame | None, before_seconds: float) -> DataFrame:
    """(qid, fast): whether the governor has latched before each question, which come in the order of qid.

    ``timings``: (qid, seconds) of the answering step, as measured by an earlier run; a question without one takes no time.
    """
    limits = config["runtime"]
    asked = questions.select("qid", F.lit("run").alias("run"))
    if timings is None:
        steps = asked.withColumn("seconds", F.lit(0.0))
    else:
        steps = asked.join(timings.select("qid", "seconds"), "qid", "left").fillna(0.0, ["seconds"])
    steps = steps.join(steps.groupBy("run").agg(F.count(F.lit(1)).alias("total")), "run")
    run = an.governor(steps, F.col("total"), limits["time_budget_hours"] * 3600, limits["fast_mode_warmup_q"], before_seconds, order=("qid",))
    return run.select("qid", F.col("fast_before").alias("fast"))


def build(config: dict, questions: DataFrame, pages: DataFrame, encoder=models.hashed_encoder, answerer=models.overlap_answerer, reranker=rank.overlap_score, strict: bool = False, rerankers: dict | None = None, timings: DataFrame | None = None, before_seconds: float = 0.0, store: VectorStore | None = None, sparse_backends: tuple[str, ...] = ("bm25",), index: postings.Index | None = None) -> Plan:
    """``questions``: (qid long, question, options map<letter, text>); ``pages``: (doc_id long, page_num long, text, and see ``page_texts``).

    ``rerankers``: the models that are there, by name; without it every model of the ladder is ``reranker``.  ``store``: where vectors are kept
    from run to run (texts that it lacks are encoded while the plan is built); without it they are computed as the plan runs.  ``index``: postings of the same pages, where they are kept.
    Chunks and summaries are encoded for the documents that ask for them only (D7, D8).
    """
    search, choose, llm, rerank_cfg = config["retrieval"], config["page_selection"], config["llm"], config["rerank"]
    events: list[str] = []
    kept: list[str] = []
    bounded_batches(pages.sparkSession)

    def _keep(df: DataFrame) -> DataFrame:
        """Several later steps read this: computed once and written (top-k rows per query, pages, or vectors that a model had to make).

        Later plans start from files of known size: small ones are broadcast, so the pages beside them are filtered in place and not shuffled.
        """
        kept.append(scratch_path(df.sparkSession))
        return written(df, kept[-1])

    def _texts_of(listed: DataFrame) -> DataFrame:
        """The texts of these pages only."""
        return texts.join(listed.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")

    def _sized(most: int, size: int):
        """The encoder with a configuration's truncation and batch, where it can be told."""
        return encoder.sized(most, size) if hasattr(encoder, "sized") else encoder

    def _embedded(rows: DataFrame, text: str, encode) -> DataFrame:
        """(doc_id, page_num, emb) of rows with a text."""
        own = rows.select("doc_id", "page_num", F.col(text).alias("text"))
        return own.select("doc_id", "page_num", encode(F.col("text")).alias("emb")) if store is None else store.embed(own, encode)

    page_encoder, query_encoder = _sized(search["bge_max_length"], search["bge_batch_size"]), _sized(search["query_max_length"], search["query_batch_size"])
    rerankers = {m: reranker for m in rerank_cfg["model_preference"]} if rerankers is None else rerankers
    chosen = pick_reranker(config, rerankers, events, strict)
    model = rerankers.get(chosen)
    model = model.sized(rerank_cfg["max_length"], rerank_cfg["batch_size"]) if hasattr(model, "sized") else model
    score_page = for_pages(model, rerank_cfg["page_text_chars"])
    governed = config["runtime"]["enable_runtime_governor"]
    texts = _keep(retrieve.neighbor_bleed(page_texts(pages, config["extraction"], events), config["extraction"]["neighbor_bleed_chars"]).select("doc_id", "page_num", F.col("bled").alias("text")))
    vectors = _keep(_embedded(texts, "text", page_encoder))
    asked = questions.select("qid", query_encoder(F.col("question")).alias("emb"))
    meta = _keep(pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")))

    structured = search["index_mode"] == "structure_chunks"
    dense = retrieve.dense_topk(vectors, asked, search["structure_seed_top_k"] if structured else search["top_k"])
    if structured:
        cut = structure_chunks("text", "page_num", search["structure_chunk_chars"], search["structure_chunk_overlap"], search["structure_heading_max_chars"], search["structure_chunk_min_chars"])
        dense = _keep(dense)  # the seeds say which documents' chunks are wanted
        wanted = retrieve.wanted_docs(dense, search["structure_doc_topn"], meta, search.get("structure_doc_page_threshold"))
        demanded = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        chunks = _embedded(demanded.select("doc_id", "page_num", F.explode(cut).alias("chunk")), "chunk", _sized(search["structure_max_length"], search["structure_bge_batch_size"]))
        dense = retrieve.chunk_retrieval(dense, chunks, asked, search["top_k"], search["structure_doc_topn"], search["structure_pages_per_doc"], meta, search.get("structure_doc_page_threshold"))
    candidates = dense
    if search["hybrid_enabled"] and search["sparse_backend"] not in sparse_backends:
        # Dense alone, if the contract allows it
        if config["contracts"]["require_bm25_backend"] or config["contracts"]["fail_on_component_fallback"]:
            raise ContractError(f"sparse backend {search['sparse_backend']} is required")
        events.append("retrieval: hybrid -> dense only")
    elif search["hybrid_enabled"]:
        wanted, most = questions.select("qid", F.col("question").alias("text")), max(search["top_k"], search["sparse_top_k"])
        sparse = retrieve.bm25_topk(texts, wanted, most) if index is None else postings.search(index, wanted, most)
        candidates = retrieve.hybrid(dense, sparse, search["top_k"], search["hybrid_rrf_k"], (search["hybrid_dense_weight"], search["hybrid_sparse_weight"]))

    candidates = _keep(candidates)
    by_doc = rerank_cfg["mode"] == "doc"
    ordered = candidates if by_doc or score_page is None else rank.rerank_pages(candidates, questions, _texts_of(candidates), score_page)
    if choose.get("lock_to_dense_top_doc"):
        flags = rank.lock_flags(candidates, meta, choose.get("lock_to_dense_top_doc_min_pages", 0), choose.get("lock_dense_by_margin_threshold"))
        ordered = rank.exhaustive_lock(ordered, flags, vectors, asked) if choose.get("lock_exhaustive_dense") else rank.locked_order(ordered, flags)
    ordered = candidates if ordered is candidates else _keep(ordered)
    rerank_flags = None
    if by_doc and model is not None:
        docs = rank.rerank_docs_unless_sure(candidates, _texts_of(candidates), questions, rerank_cfg["doc_skip_topn"], rerank_cfg["doc_skip_margin"], model, most_docs=rerank_cfg["doc_candidates_max"], preview_pages=rerank_cfg["doc_preview_pages"], page_chars=rerank_cfg["page_text_chars"])
        docs = _keep(docs)
        rerank_flags, docs = rank.rerank_changes(candidates, docs), docs.drop("skipped")
    elif structured and search["structure_doc_guard_enabled"]:
        docs = rank.guarded_ranking(ordered, search["structure_doc_guard_top_pages"], search["structure_doc_guard_secondary_weight"])
    else:
        docs = rank.doc_ranking(ordered)

    docs = _keep(docs)
    shown = an.doc_mode_order(candidates, docs) if by_doc else ordered
    flags = _keep(fast_flags(config, questions, timings, before_seconds)) if governed else None
    fast = F.col("fast") if governed else F.lit(False)
    caps = config["runtime"]

    def context_of(listed: DataFrame) -> DataFrame:
        """G1, with fewer and shorter pages once the governor has latched."""
        most, chars, texts = llm["top_k_context"], llm["max_chars_per_page"], _texts_of(listed)
        if not governed:
            return an.build_context(listed, texts, most, chars)
        flagged = listed.join(flags, "qid")
        few, short = min(most, caps["fast_context_pages_cap"]), min(chars, caps["fast_max_chars_per_page_cap"])
        return an.build_context(flagged.where(~fast).drop("fast"), texts, most, chars).unionByName(an.build_context(flagged.where(fast).drop("fast"), texts, few, short))

    contexts = _keep(context_of(shown))
    tops = docs.where("rank = 1").select("qid", "doc_id")
    margins = docs.groupBy("qid").agg(rank.top_margin().alias("doc_margin"), F.count(F.lit(1)).alias("n_docs")).join(rank.margins(ordered).withColumnRenamed("margin", "page_margin"), "qid").join(tops.join(meta, "doc_id", "left").select("qid", F.col("n_pages").alias("top_pages")), "qid", "left")
    if governed:
        margins = margins.join(flags, "qid")
    margins = _keep(margins)
    effort = an.passes("doc_margin", "n_docs", "page_margin", "top_pages", llm["base_passes"], llm["hard_passes"], llm["vote_margin"], llm["long_doc_hard_pages"], llm["confidence_gate_enabled"], llm["easy_passes"], llm["easy_doc_margin"], llm["easy_page_margin"], fast if governed else None)
    tries = margins.select("qid", F.explode(F.sequence(F.lit(1), effort)).alias("pass_no"))
    chat = llm.get("use_chat_template", False)

    def requested(passes: DataFrame, about: DataFrame) -> DataFrame:
        """One row for each call of the model; the first pass at temperature 0, the others at ``vote_temp``."""
        asked_for = passes.join(about, "qid").join(questions.select("qid", "question", "options"), "qid")
        listed = {k: F.try_element_at("options", F.lit(k)) for k in OPTION_LETTERS}
        return asked_for.select(
            "qid",
            "pass_no",
            prompt("context", "question", listed, llm["prompt_variant"]).alias("prompt"),
            F.lit(llm.get("chat_system_prompt", CHAT_SYSTEM) if chat else None).cast("string").alias("system"),
            F.when(F.col("pass_no") == 1, 0.0).otherwise(llm["vote_temp"]).alias("temperature"),
            F.lit(4 if chat else 3).alias("max_tokens"),
            F.array(*map(F.lit, CHAT_STOPS if chat else STOPS)).alias("stop"),
            "context",
            "options",
        )

    def answered(requests: DataFrame) -> DataFrame:
        return requests.select("qid", "pass_no", answerer(F.struct("prompt", "system", "temperature", "max_tokens", "stop", "pass_no", "context", "options")).alias("letter"))

    requests = requested(tries, contexts)
    votes = answered(requests)
    if llm.get("dual_context_passes", 0) > 0:
        other = context_of(dense)
        both = contexts.join(other.withColumnRenamed("context", "other_context"), "qid")
        more = both.where("context <> other_context").select("qid", F.explode(F.sequence(F.lit(1), F.lit(llm["dual_context_passes"]))).alias("pass_no"))
        extra = requested(more, other)
        votes = an.dual_votes(votes, answered(extra), both)
        requests = requests.unionByName(extra)
    voted = _keep(an.majority(votes))

    if choose["answer_conditioning"] == "disabled":
        queries = asked
    else:
        augmented = questions.join(voted.select("qid", "letter"), "qid").select("qid", F.trim(F.concat_ws(" ", "question", F.coalesce(F.try_element_at("options", F.col("letter")), F.lit("")))).alias("text"))
        queries = augmented.select("qid", query_encoder(F.col("text")).alias("emb"))
    strategy = choose["strategy"]
    if strategy == "same_doc_answer_aware":
        placed = locate.same_doc(ordered, tops, queries, vectors)
    elif strategy == "summary_then_answer_aware":
        demanded = texts.join(tops.select("doc_id").distinct(), "doc_id", "left_semi")
        summaries = _embedded(with_page_summary(demanded, choose["summary_chars"], choose["summary_heading_max_chars"]), "summary", _sized(choose["summary_max_length"], search["structure_bge_batch_size"]))
        placed = locate.summary_then_answer(tops, asked, queries, summaries, vectors, choose["summary_topk"])
    else:
        segments = None
        if choose["segment_mode"] != "disabled":
            lazy = choose["segment_mode"] == "lazy"
            cut = retrieve.segment_rows(texts, choose["segment_window"], choose["segment_stride"], tops if lazy else None, choose["short_doc_max_pages"] if lazy else None)
            segments = _embedded(cut, "segment", _sized(choose["segment_max_length"], search["structure_bge_batch_size"]))
        scores = locate.page_scores(tops, queries, vectors, segments)
        if strategy == "avir_threshold":
            placed = locate.threshold(scores, ordered, choose["threshold_delta"], choose["threshold_max_pages"])
        else:
            listed = locate.locked_top_k(scores, choose["page_select_topk"], choose["stage2_margin"] if choose["stage2_mode"] == "adaptive" else None)
            if choose["stage2_mode"] == "disabled":
                placed = listed.where("rank = 1")
            else:
                wanted = F.lit(True) if choose["stage2_mode"] == "always" else F.col("stage2")
                if governed and caps["fast_disable_page_stage2"]:
                    listed = listed.join(flags, "qid")
                    wanted &= ~fast
                if model is None:
                    wanted = F.lit(False)
                again = rank.rerank_pages(listed.where(wanted).select("qid", "doc_id", "page_num", "score", "rank"), questions, _texts_of(listed), score_page)
                placed = again.where("rank = 1").select("qid", "doc_id", "page_num", "score").unionByName(listed.where(~wanted & (F.col("rank") == 1)).select("qid", "doc_id", "page_num", "score"))
    predictions = questions.select("qid").join(voted.select("qid", "letter", "confidence"), "qid", "left").join(tops.withColumnRenamed("doc_id", "pred_doc"), "qid", "left").join(placed.select("qid", "page_num"), "qid", "left").select(F.col("qid").cast("string").alias("Question_ID"), F.coalesce("letter", F.lit(OPTION_LETTERS[0])).alias("Correct_Answer"), F.col("pred_doc").cast("string").alias("Doc_ID"), F.coalesce("page_num", F.lit(1)).cast("string").alias("Page_Num"))
    return Plan(predictions, {"dense": dense, "candidates": candidates, "pages": ordered, "docs": docs}, contexts, votes, requests, events, {"reranker": chosen, "llm": config.get("llm_model", "default")}, rerank_flags, kept)
