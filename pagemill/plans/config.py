"""Named configurations with single inheritance, overrides and contracts."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# The defaults and the named configurations.
BASE = {
    "extraction": {"mode": "raw", "neighbor_bleed_chars": 200, "table_aware": False},
    "retrieval": {
        "top_k": 20, "index_mode": "page", "hybrid_enabled": False, "sparse_backend": "bm25", "sparse_top_k": 40, "hybrid_rrf_k": 60, "hybrid_dense_weight": 1.0, "hybrid_sparse_weight": 1.0,
        "structure_seed_top_k": 60, "structure_doc_topn": 3, "structure_pages_per_doc": 6, "structure_chunk_chars": 700, "structure_chunk_overlap": 120, "structure_heading_max_chars": 120, "structure_chunk_min_chars": 180,
        "bge_max_length": 1536, "bge_batch_size": 8, "query_max_length": 256, "query_batch_size": 32, "structure_max_length": 512, "structure_bge_batch_size": 32,
        "structure_doc_guard_enabled": False, "structure_doc_guard_top_pages": 2, "structure_doc_guard_secondary_weight": 0.35,
    },
    "rerank": {"mode": "page", "model_preference": ["bge"], "max_length": 1024, "batch_size": 8, "page_text_chars": 4000, "doc_candidates_max": 6, "doc_preview_pages": 2, "doc_skip_topn": 3, "doc_skip_margin": 0.035},
    "llm": {"prompt_variant": "v4_evidence", "top_k_context": 4, "max_chars_per_page": 3500, "base_passes": 1, "hard_passes": 1, "easy_passes": 1, "confidence_gate_enabled": False, "easy_doc_margin": 0.12, "easy_page_margin": 0.05, "vote_temp": 0.5, "vote_margin": 0.08, "long_doc_hard_pages": 80, "n_ctx_candidates": [8192, 4096]},
    "page_selection": {
        "strategy": "same_doc_answer_aware", "answer_conditioning": "predicted_answer", "page_select_topk": 3, "segment_mode": "disabled", "segment_window": 900, "segment_stride": 512, "summary_topk": 3, "summary_chars": 320, "summary_heading_max_chars": 120,
        "summary_max_length": 256, "segment_max_length": 256, "threshold_delta": 0.02, "threshold_max_pages": 4, "short_doc_max_pages": 12, "stage2_mode": "disabled", "stage2_margin": 0.03,
    },
    "contracts": {"fail_on_component_fallback": False, "require_reranker": None, "require_gguf_filename": None, "require_n_ctx": None, "require_bm25_backend": False},
    "runtime": {"enable_runtime_governor": False, "time_budget_hours": 8.5, "fast_mode_warmup_q": 25, "fast_context_pages_cap": 3, "fast_max_chars_per_page_cap": 2500, "fast_disable_page_stage2": True},
}
_GOVERNED = {"enable_runtime_governor": True}
_LOCK = {"lock_to_dense_top_doc": True}
PRESETS: dict[str, dict] = {
    "base_local": BASE,
    "v7_baseline": {"inherits": "base_local", "rerank": {"model_preference": ["qwen3_0_6b", "bge"], "max_length": 2048, "batch_size": 4}, "llm": {"base_passes": 3, "hard_passes": 3}, "contracts": {"require_reranker": "qwen3_0_6b", "require_gguf_filename": "MamayLM-Gemma-3-12B-IT-v1.0.Q4_K_M.gguf", "require_n_ctx": 8192}},
    "v8_quality_branch": {"inherits": "base_local", "retrieval": {"bge_max_length": 2048}, "rerank": {"model_preference": ["qwen3_4b", "bge"], "batch_size": 4}, "llm": {"top_k_context": 5, "max_chars_per_page": 4000, "base_passes": 3, "hard_passes": 3}, "page_selection": {"strategy": "locked_top_doc_all_pages", "segment_mode": "precompute", "segment_window": 1100, "segment_stride": 256, "stage2_mode": "always"}},
    "v9_regression": {"inherits": "base_local", "retrieval": {"top_k": 16}, "rerank": {"mode": "doc", "model_preference": ["qwen3_4b", "bge"], "batch_size": 4}, "llm": {"max_chars_per_page": 3200, "hard_passes": 3}, "contracts": {"require_reranker": "qwen3_4b", "require_gguf_filename": "MamayLM-Gemma-3-12B-IT-v1.0.Q4_K_M.gguf", "require_n_ctx": 8192}, "page_selection": {"strategy": "locked_top_doc_all_pages", "segment_mode": "lazy", "stage2_mode": "adaptive"}, "runtime": _GOVERNED},
    "candidate_lazy_segments_v1": {"inherits": "v7_baseline", "page_selection": {"strategy": "locked_top_doc_all_pages", "segment_mode": "lazy", "stage2_mode": "adaptive"}},
    "candidate_locked_top_doc_v1": {"inherits": "v7_baseline", "page_selection": {"strategy": "locked_top_doc_all_pages"}},
    "candidate_structure_chunks_v1": {"inherits": "v7_baseline", "retrieval": {"index_mode": "structure_chunks"}},
    "candidate_structure_chunks_v3_short_doc": {"inherits": "candidate_structure_chunks_v1", "retrieval": {"structure_doc_page_threshold": 25}},
    "candidate_structure_chunks_v2_doc_guard": {"inherits": "candidate_structure_chunks_v1", "retrieval": {"structure_doc_guard_enabled": True}},
    "candidate_page_summary_selector_v1": {"inherits": "v7_baseline", "page_selection": {"strategy": "summary_then_answer_aware"}},
    "candidate_avir_threshold_v1": {"inherits": "v7_baseline", "page_selection": {"strategy": "avir_threshold"}},
    "candidate_stronger_reranker_v1": {"inherits": "v7_baseline", "rerank": {"model_preference": ["qwen3_4b", "qwen3_0_6b", "bge"], "max_length": 1024}},
    "candidate_stronger_reranker_v2_fair": {"inherits": "v7_baseline", "rerank": {"model_preference": ["qwen3_4b", "qwen3_0_6b", "bge"]}, "contracts": {"require_reranker": "qwen3_4b", "require_gguf_filename": "MamayLM-Gemma-3-12B-IT-v1.0.Q4_K_M.gguf", "require_n_ctx": 8192}},
    "candidate_v5refocus_reranker4b_fair": {"inherits": "candidate_stronger_reranker_v2_fair", "llm": {"prompt_variant": "v5_refocus"}},
    "candidate_stronger_reranker_v3_8b_fair": {"inherits": "v7_baseline", "rerank": {"model_preference": ["qwen3_8b", "qwen3_4b", "qwen3_0_6b", "bge"]}, "contracts": {"require_reranker": "qwen3_8b", "require_gguf_filename": "MamayLM-Gemma-3-12B-IT-v1.0.Q4_K_M.gguf", "require_n_ctx": 8192}},
    "candidate_stronger_reranker_v3_8b_feasibility": {"inherits": "candidate_stronger_reranker_v3_8b_fair"},
    "candidate_conditional_voting_v1": {"inherits": "v7_baseline", "llm": {"base_passes": 1, "hard_passes": 3}},
    "candidate_runtime_guard_v1": {"inherits": "candidate_conditional_voting_v1", "runtime": _GOVERNED},
    "candidate_confidence_gated_v1": {"inherits": "v7_baseline", "llm": {"easy_passes": 1, "confidence_gate_enabled": True}},
    "candidate_hybrid_rrf_v1": {"inherits": "v7_baseline", "retrieval": {"hybrid_enabled": True}, "contracts": {"require_bm25_backend": True}},
    "candidate_extraction_blocks_v1": {"inherits": "v7_baseline", "extraction": {"mode": "blocks", "table_aware": True}},
    "candidate_no_bleed_v1": {"inherits": "v7_baseline", "extraction": {"neighbor_bleed_chars": 0}},
    "candidate_evidence_first_v1": {"inherits": "v7_baseline", "page_selection": {"answer_conditioning": "disabled"}},
    "candidate_dense_doc_lock_v1": {"inherits": "v7_baseline", "page_selection": _LOCK},
    "candidate_dense_doc_lock_v2": {"inherits": "v7_baseline", "page_selection": _LOCK | {"lock_to_dense_top_doc_min_pages": 25}},
    "candidate_dense_doc_lock_v3": {"inherits": "v7_baseline", "page_selection": _LOCK | {"lock_to_dense_top_doc_min_pages": 27}},
    "candidate_dense_doc_lock_v3_reranker4b_fair": {"inherits": "candidate_dense_doc_lock_v3", "rerank": {"model_preference": ["qwen3_4b", "qwen3_0_6b", "bge"]}, "contracts": {"require_reranker": "qwen3_4b", "require_gguf_filename": "MamayLM-Gemma-3-12B-IT-v1.0.Q4_K_M.gguf", "require_n_ctx": 8192}},
    "candidate_v5refocus_ddl_v3_reranker4b_fair": {"inherits": "candidate_dense_doc_lock_v3_reranker4b_fair", "llm": {"prompt_variant": "v5_refocus"}},
    "candidate_chat_template_v1": {"inherits": "candidate_dense_doc_lock_v3", "llm": {"use_chat_template": True}},
    "candidate_chat_template_v2": {"inherits": "candidate_dense_doc_lock_v3", "llm": {"use_chat_template": True}},
    "candidate_ddl_v3_exhaustive": {"inherits": "candidate_dense_doc_lock_v3", "page_selection": {"lock_exhaustive_dense": True}},
    "candidate_v5_refocus_v1": {"inherits": "v7_baseline", "llm": {"prompt_variant": "v5_refocus"}},
    "candidate_dense_margin_lock_v1": {"inherits": "v7_baseline", "page_selection": _LOCK | {"lock_dense_by_margin_threshold": 0.25}},
    "candidate_v5refocus_margin_lock_v1": {"inherits": "candidate_dense_margin_lock_v1", "llm": {"prompt_variant": "v5_refocus"}},
    "candidate_lapalm_v1": {"inherits": "candidate_dense_doc_lock_v3", "llm_model": "lapalm", "contracts": {"require_gguf_filename": None}},
}


class ContractError(RuntimeError):
    """A configuration asks for a component that is not there."""


def deep_merge(base: dict, over: dict) -> dict:
    """Dictionaries are merged key by key; anything else is replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def load(path: str | None = None) -> dict[str, dict]:
    """Configurations of a JSON file, or the built-in ones."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else PRESETS


def resolve(name: str, overrides: dict | None = None, presets: dict[str, dict] | None = None) -> dict:
    """The configuration with everything it inherits, then the overrides."""
    presets = PRESETS if presets is None else presets
    if name not in presets:
        raise KeyError(f"no such configuration: {name}")
    own = {k: v for k, v in presets[name].items() if k != "inherits"}
    parent = presets[name].get("inherits")
    out = deep_merge(resolve(parent, presets=presets) if parent else {}, own)
    if "name" not in own:
        out["name"] = name
    return deep_merge(out, overrides or {})


def check_contracts(config: dict, reranker: str | None, gguf: str | None = None, n_ctx: int | None = None, bm25: bool = True) -> list[str]:
    """Fallback events; raises where the contracts forbid them."""
    need = config["contracts"]
    events = []
    preferred = config["rerank"]["model_preference"]
    if preferred and reranker != preferred[0]:
        events.append(f"reranker: {preferred[0]} -> {reranker}")
    if config["retrieval"]["hybrid_enabled"] and not bm25:
        events.append("retrieval: hybrid -> dense only")
    wrong = [(k, want, got) for k, want, got in (("require_reranker", need.get("require_reranker"), reranker), ("require_gguf_filename", need.get("require_gguf_filename"), gguf), ("require_n_ctx", need.get("require_n_ctx"), n_ctx)) if want is not None and want != got]
    if wrong:
        raise ContractError("; ".join(f"{k}: {want} wanted, {got} found" for k, want, got in wrong))
    if need.get("require_bm25_backend") and not bm25:
        raise ContractError("require_bm25_backend: no sparse ranking")
    if events and need.get("fail_on_component_fallback"):
        raise ContractError("; ".join(events))
    return events


def repeats(n: int, base_seed: int = 42) -> list[dict]:
    """Seed and number of each repeat of a run."""
    return [{"seed": base_seed + i, "repeat": i} for i in range(n)]
