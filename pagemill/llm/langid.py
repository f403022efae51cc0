"""Operator 7: language identification by averaged hashed subword embeddings and a linear softmax.

Features of a text: hashed byte 1- to 4-grams within lower-cased words (a space on both sides of each word), averaged.  Model:
embedding table (``BUCKETS`` x ``DIM``) and a linear softmax, trained by stochastic
gradient descent in numpy on the driver.  The average and the softmax layer are both linear in
the table, so for prediction they are multiplied once into one row of logits per bucket.

Training rows: a bounded sample of the labelled training documents; every language gives about
``PER_LANGUAGE`` rows (all, if it has fewer; less with over 33 languages), picked by the hash of doc_id so that
reruns agree; whole texts are used.  ``SAMPLE_BOUND`` is the hard bound of the sample.

No more than ``SAMPLE_BYTES`` of text are taken.  Every language has an equal share of them, which it fills in the order of the draw; a
text larger than its language's share is left out of the sample and takes nothing from the others.  Only where a language has no other
text, its smallest drawn one is cut at the share, at the end of a character, so that no language is lost to its long texts.

Calibration: a temperature is fitted on a part of the sample that training does not see, on its whole texts and on a slice of each
length of ``SLICES`` words of every text, as whole texts alone are hardly ever wrong.  The average says nothing of a text's length, so
logits are multiplied by a power of the number of its n-grams, which is fitted as well; ``score`` is the calibrated
probability of the prediction, ``rejected`` is set if it is under the threshold: the least score from which on
accuracy on that part is ``TARGET_ACCURACY``.  ``coverage`` of the model is the share of that part at or above it.  ``lang_pred`` stays the best language, as users may want
another threshold; only texts without any letter are ``und``.

Defined results: null text or no letter: ``und``, score 0; no labelled training row at all: ``und`` for every text;
one language only: that language; repeated rows: each is predicted; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Words, blocks, texts_of

BUCKETS = 1 << 14
DIM = 16
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 600
SAMPLE_BOUND = 20_000
SAMPLE_BYTES = 128 << 20
SLICES = (1, 2, 4, 8, 16, 32)
EPOCHS = 12
RATE = 4.0
TARGET_ACCURACY = 0.99
_SEED = 7


def held_out(doc_id) -> object:
    """crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its document) of a block."""
    buf = w.data
    solid = np.zeros(len(buf) + 1, np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    solid = np.cumsum(solid[:-1], dtype=np.int8) > 0
    # bytes of words, and one space before and after each
    value = np.where(solid, buf, 32).astype(np.uint32)
    doc = np.searchsorted(w.doc_start, np.arange(len(buf)), "right") - 1
    out, docs = [], []
    for n in GRAMS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        inner = np.zeros(m, np.uint8)
        for j in range(n):
            h = (h ^ value[j : j + m]) * np.uint32(0x01000193)
            if 0 < j < n - 1:
                inner |= ~solid[j : j + m]
        h ^= h >> np.uint32(15)
        keep = (inner == 0) & (doc[:m] == doc[n - 1 :]) & (solid[:m] | solid[n - 1 :])
        if n == 1:
            keep &= solid[:m]
        out.append(h[keep] & np.uint32(BUCKETS - 1))
        docs.append(doc[:m][keep])
    return (np.concatenate(out), np.concatenate(docs)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embedding times softmax layer
    bias: np.ndarray
    temperature: float
    threshold: float
    coverage: float = 0.0
    growth: float = 0.0

    def calibrated(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities from the average logits of texts of ``n`` n-grams."""
        return softmax(z * (np.maximum(n, 1) ** self.growth / self.temperature)[:, None])

    def predict(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, calibrated probability) of each document."""
        bucket, doc = features(w)
        n = np.maximum(np.bincount(doc, minlength=w.n_docs), 1)
        z = np.stack([np.bincount(doc, self.logits[bucket, k], minlength=w.n_docs) for k in range(len(self.languages))], 1)
        p = self.calibrated(z / n[:, None] + self.bias, n)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, their shares, number of n-grams) of each text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for a, b in blocks(offsets):
        bucket, doc = features(Words(data, offsets, a, b, lower=True))
        key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
        edges = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
        for i in range(b - a):
            c = count[edges[i] : edges[i + 1]]
            rows.append((key[edges[i] : edges[i + 1]] % BUCKETS, (c / max(c.sum(), 1)).astype(np.float32), int(c.sum())))
    return rows


def _slices(texts: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    """The texts, and of each a run of words of every length that it exceeds, with their labels."""
    out, own = list(texts), list(labels)
    for t, y in zip(texts, labels):
        words = t.split()
        for n in SLICES:
            if len(words) > n:
                at = int(rng.integers(len(words) - n + 1))
                out.append(b" ".join(words[at : at + n]))
                own.append(y)
    return out, np.array(own)


def train(texts: list[bytes], labels: list[str]) -> Model | None:
    """Fit the model on labelled texts; None without any."""
    if not texts:
        return None
    languages = sorted(set(labels))
    rows = _rows(texts)
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(_SEED)
    order = rng.permutation(len(rows))
    check, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    if not len(fit):
        check, fit = order[:0], order
    k = len(languages)
    table, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            bucket, share, _ = rows[i]
            h = share @ table[bucket]
            z = h @ layer + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            table[bucket] -= (rate * share)[:, None] * (layer @ g)
            layer -= 0.1 * rate * np.outer(h, g)
            bias -= 0.01 * rate * g
    logits = (table @ layer).astype(np.float64)
    model = Model(languages, logits, bias.astype(np.float64), 1.0, 0.0)
    if len(check):
        held, truth = _slices([texts[i] for i in check], y[check], rng)
        kinds = _rows(held)
        z, n = np.array([share @ logits[bucket] for bucket, share, _ in kinds]) + bias, np.array([x[2] for x in kinds])

        def loss(model: Model) -> float:
            return -np.log(np.maximum(model.calibrated(z, n)[np.arange(len(z)), truth], 1e-12)).mean()

        grid = [Model(languages, model.logits, model.bias, float(t), 0.0, growth=float(g)) for t in np.geomspace(1 / 64, 64, 61) for g in np.arange(0, 1.01, 0.1)]
        model = min(grid, key=loss)
        p = model.calibrated(z, n)
        best, right = p.max(1), p.argmax(1) == truth
        down = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= TARGET_ACCURACY)
        model.threshold = float(best[down][good[-1]]) if len(good) else 1.0
        model.coverage = float((best >= model.threshold).mean())
    return model


def whole_characters(text: bytes) -> bytes:
    """``text`` without a last character that a cut has left incomplete."""
    return text.decode("utf-8", "ignore").encode()


def fit(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> Model | None:
    """Train on the bounded sample of the labelled training documents."""
    labelled = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(False)))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_BOUND).collect()
    if not counts:
        return None
    each = min(PER_LANGUAGE, max(1, SAMPLE_BOUND // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, each / r["n"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(_SEED)), F.lit(1 << 20)) / float(1 << 20)
    text = F.encode("text", "utf-8").alias("text")
    # ties of the draw by id and text: reruns take the same rows
    order = [draw.alias("draw"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")]
    drawn = labelled.where(draw < share).select("lang", text, "doc_id", F.octet_length("text").cast("long").alias("size"), *order).orderBy("draw", "id", "hash").limit(SAMPLE_BOUND)
    room = SAMPLE_BYTES // len(counts)
    fits = (F.col("size") <= room).cast("int")
    own = Window.partitionBy("lang")
    upto = F.sum(F.col("size") * fits).over(own.orderBy("draw", "id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a language of giants only: its smallest drawn text, cut
    least = F.row_number().over(own.orderBy("size", "draw", "id", "hash"))
    placed = drawn.withColumn("fits", fits).withColumn("upto", upto).withColumn("any", F.max(fits).over(own)).withColumn("least", least)
    taken = placed.where(((F.col("fits") == 1) & (F.col("upto") <= room)) | ((F.col("any") == 0) & (F.col("least") == 1)))
    sample = taken.select("lang", F.substring("text", 1, room).alias("text"), "doc_id").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    return train([whole_characters(bytes(t)) for t in sample["text"]], sample["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document; only the text is an input of the prediction."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            letters = np.asarray(batch.column(3))
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for a, b in blocks(offsets) if model else ():
                x, p = model.predict(Words(data, offsets, a, b, lower=True))
                best.append(x)
                score.append(p)
            n = batch.num_rows
            known = letters if model else np.zeros(n, bool)
            index, prob = (np.concatenate(best), np.concatenate(score)) if model else (np.zeros(n, np.int64), np.zeros(n))
            names = np.array(model.languages if model else ["und"], object)[index]
            names[~known] = "und"
            prob = np.where(known, np.clip(prob, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(prob), pa.array(prob < (model.threshold if model else 1.0))], schema=schema)

    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
