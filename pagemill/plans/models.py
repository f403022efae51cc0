"""Model protocols and deterministic offline stand-ins.

A model is a function from columns to a column.  The stand-ins are good for
plans and tests; they make no claim about the quality of real models.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import tokens


class Encoder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Answerer(Protocol):
    """``request``: a struct of prompt, system (null without a chat template), temperature, max_tokens, pass_no, context and options."""

    def __call__(self, request: Column) -> Column: ...


DIM = 256


def hashed_encoder(text: Column) -> Column:
    """L2-normalised counts of hashed words: an encoder that needs no weights."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # lists stay flat: an object for each row and number would be most of the work
        for hashed in batches:
            n, sizes = len(hashed), np.asarray(pc.fill_null(pc.list_value_length(hashed), 0), np.int64)
            flat = np.asarray(hashed.flatten(), np.int64)
            counts = np.bincount(np.repeat(np.arange(n), sizes) * DIM + flat % DIM, minlength=n * DIM).reshape(-1, DIM)
            counts = counts / np.maximum(np.linalg.norm(counts, axis=1), 1e-12)[:, None]
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DIM), pa.array(counts.astype(np.float32).ravel()))

    return encode(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(1 << 31))))


def overlap_answerer(request: Column) -> Column:
    """The option with most of its distinct words in the context; the first if tied.  All passes agree, whatever prompt and temperature."""
    words = tokens(request["context"])
    scored = F.transform(F.map_entries(request["options"]), lambda e: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(e["value"])), words))).alias("score"), e["key"].alias("letter")))
    return F.element_at(F.array_sort(scored), 1)["letter"]
