"""Real models in a plan (D1, D2, F1, F2, G2): loaded once per Python worker, fed in bounded batches, truncated as configured.

A model is brought by a ``load`` function without arguments, which runs on the executors; what it returns stays in the worker, under the
model's name, for all tasks and plans that follow.  A text model has ``bos`` and ``eos`` (token ids), ``tokens(text) -> list of ids``, and

* an encoder: ``hidden(ids, mask) -> array (texts, tokens, width)``; the first token's state is taken and scaled to length 1;
* a cross-encoder: ``logits(ids, mask) -> array (texts,)``, or (texts, 2) with "no" and "yes" for a generative one;
* a generator (no tokens needed): ``complete(prompt, system, max_tokens, temperature, stop) -> text``.

Texts of an Arrow batch are sorted by length before they are cut into model batches, so padding stays small; results come back in the order of the rows.
Rows with a null text count as the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import answer, pair_text

#: Models of this Python worker by name.
_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def cut(ids: list[int], bos: int, eos: int, most: int) -> list[int]:
    """Truncation that keeps both end tokens; ``most`` counts them."""
    return [bos, *ids[: max(0, most - 2)], eos]


def model_batches(ids: list[list[int]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, padded ids, mask) of at most ``size`` texts each, shortest first."""
    order = np.argsort([len(x) for x in ids], kind="stable")
    for a in range(0, len(order), size):
        at = order[a : a + size]
        width = max(len(ids[i]) for i in at)
        padded, mask = np.zeros((len(at), width), np.int64), np.zeros((len(at), width), np.int64)
        for row, i in enumerate(at):
            padded[row, : len(ids[i])], mask[row, : len(ids[i])] = ids[i], 1
        yield at, padded, mask


def run_batches(model, texts: list[str], most: int, size: int, forward: str) -> np.ndarray:
    """``forward`` of the model for all texts, in their order."""
    ids = [cut(model.tokens(t), model.bos, model.eos, most) for t in texts]
    out = None
    for at, padded, mask in model_batches(ids, size):
        got = np.asarray(getattr(model, forward)(padded, mask))
        got = got[:, 0] if forward == "hidden" else got
        out = np.zeros((len(texts), *got.shape[1:]), np.float64) if out is None else out
        out[at] = got
    return out


@dataclass(frozen=True)
class TextEncoder:
    """D1, D2. ``sized``: the same model with another truncation or batch; ``key`` names what its vectors depend on."""

    name: str
    load: Callable[[], object]
    max_length: int = 512
    batch_size: int = 8

    @property
    def key(self) -> str:
        return f"{self.name}-{self.max_length}"

    def sized(self, max_length: int, batch_size: int) -> TextEncoder:
        return replace(self, max_length=max_length, batch_size=batch_size)

    def __call__(self, text: Column) -> Column:
        name, load, most, size = self.name, self.load, self.max_length, self.batch_size

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for texts in batches:
                if not len(texts):
                    yield pd.Series([], dtype=object)
                    continue
                states = run_batches(model, texts.tolist(), most, size, "hidden")
                states = states / np.maximum(np.linalg.norm(states, axis=1), 1e-12)[:, None]
                yield pd.Series(list(states.astype(np.float32)))

        return encode(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class CrossEncoder:
    """F1, F2: a score of (question, text). ``generative``: the pair is a prompt (C9) and the score the probability of "yes" (F1a), else the raw logit of the two texts."""

    name: str
    load: Callable[[], object]
    generative: bool = False
    max_length: int = 1024
    batch_size: int = 4

    def sized(self, max_length: int, batch_size: int) -> CrossEncoder:
        return replace(self, max_length=max_length, batch_size=batch_size)

    def __call__(self, question: Column, text: Column) -> Column:
        name, load, most, size, generative = self.name, self.load, self.max_length, self.batch_size, self.generative

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for texts in batches:
                if not len(texts):
                    yield pd.Series([], dtype=float)
                    continue
                logits = run_batches(model, texts.tolist(), most, size, "logits")
                yield pd.Series(1 / (1 + np.exp(logits[:, 0] - logits[:, 1])) if generative else logits.reshape(-1))

        asked, given = F.coalesce(question, F.lit("")), F.coalesce(text, F.lit(""))
        return score(pair_text(asked, given) if generative else F.concat_ws("\n", asked, given))


def for_pages(scorer, page_chars: int) -> Callable[[Column, Column], Column]:
    """F1: what a page's text becomes before it is scored: a prompt cuts it itself (C9), a classifier gets its first ``page_chars`` characters."""
    return scorer if scorer is None or getattr(scorer, "generative", False) else lambda question, text: scorer(question, F.left(text, F.lit(page_chars)))


def stopped(text: str, stop: list[str]) -> str:
    """The text before the first stop sequence."""
    ends = [i for i in (text.find(s) for s in stop) if i >= 0]
    return text[: min(ends)] if ends else text


@dataclass(frozen=True)
class Generator:
    """One letter a request (prompt, system, temperature, max_tokens, stop); what the model returns beyond a stop sequence is cut."""

    name: str
    load: Callable[[], object]

    def __call__(self, request: Column) -> Column:
        name, load = self.name, self.load

        @F.pandas_udf("string")
        def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for rows in batches:
                calls = zip(rows["prompt"], rows["system"], rows["max_tokens"], rows["temperature"], rows["stop"])
                yield pd.Series([stopped(model.complete(p, s, int(n), float(t), list(stop)), list(stop)) for p, s, n, t, stop in calls], dtype=object)

        names = ("prompt", "system", "max_tokens", "temperature", "stop")
        return answer(complete(F.struct(*[request[c].alias(c) for c in names])))
