"""Language identification by string kernels.

A text's features are the byte n-grams of lengths 1 to 4 that it holds (presence, not counts), hashed
into ``CELLS`` cells: the blended-spectrum presence kernel of two texts is the number of cells that
they share, divided by the root of the product of their numbers. ``LANDMARKS`` training texts, an
equal number from each language, span a Nyström map: kernels with the landmarks, times the inverse
root of the landmarks' own kernel matrix. In that space one-versus-rest ridge regression gives one
column of weights per language, so a batch of texts is scored by two matrix products.

Fitting (bounded): ``FIT_ROWS`` ids, the first by hash, of the rows outside the held-out fold that
have a language and a letter; whole texts of any length are turned into cells on the executors, and
only cells come to the driver. Texts are cased down and digits and punctuation count as blanks. Scores are a softmax of
the margins, its steepness fitted on a fifth of these rows.

Edge cases. Null text or one without a letter: und, score 0. Null language: not learnt from. Null
doc_id: held_out false, predicted like others. One language only: it is predicted, with score 1; none:
und. Repeated rows: alike; of several texts or languages of one id the least is learnt. Equal margins:
the first language in order. Very long texts: whole, in slices. Empty table: no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_arrow
from quillmesh.llm.quality import remainder

FIT_ROWS, LANDMARKS = 3000, 192
CELLS, LENGTHS = 8192, (1, 2, 3, 4)
RIDGE = 1e-3
UNKNOWN = "und"

_PLAIN = re.compile(r"[A-Za-z]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
# Bytes that count as blanks: controls, digits and ASCII punctuation.
_BLANK = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_PLAIN.search(text)) or any(c.isalpha() for c in text))


def presence(text: str) -> np.ndarray:
    """Which cells hold an n-gram of the text."""
    out = np.zeros(CELLS, bool)
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" ", np.uint8)
    for begin in range(0, len(raw), 1 << 20):
        part = raw[begin : begin + (1 << 20) + LENGTHS[-1]].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in LENGTHS:
            if len(part) < n:
                break
            m = len(part) - n + 1
            code = code[:m] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            out[(code * _MULTIPLIERS[n - 1]) >> np.uint32(32 - 13)] = True
    return out


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of presence, each of unit length."""
    x = np.asarray(rows, np.float32).reshape(len(rows), CELLS)
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


class Model:
    """Landmarks (with the Nyström map and the regression's weights folded into one matrix)."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, bias: np.ndarray, steep: float):
        self.languages, self.landmarks, self.weights, self.bias, self.steep = languages, landmarks, weights, bias, steep

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for a in range(0, len(known), 128):
            rows = known[a : a + 128]
            if len(self.languages) == 1:
                found, share = np.zeros(len(rows), int), np.ones(len(rows))
            else:
                margin = (matrix([presence(texts[i]) for i in rows]) @ self.landmarks.T) @ self.weights + self.bias
                p = np.exp(np.clip(self.steep * (margin - margin.max(axis=1, keepdims=True)), -50, 0))
                p /= p.sum(axis=1, keepdims=True)
                found, share = p.argmax(axis=1), p.max(axis=1)
            for i, k, s in zip(rows, found, share, strict=True):
                names[i], scores[i] = self.languages[k], min(1.0, float(s))
        return names, scores


def train(cells: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """The model of some rows of presence and their languages."""
    names = sorted(set(languages))
    if len(names) < 2:
        return Model(names, np.zeros((0, CELLS), np.float32), np.zeros((0, len(names)), np.float32), np.zeros(len(names), np.float32), 1.0)
    x = matrix(cells)
    y = np.asarray([names.index(s) for s in languages])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T).astype(np.float64) @ root
    check = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = ~check
    # Classes of unequal size weigh alike.
    share = np.bincount(y[fit], minlength=len(names))
    w = (1.0 / np.maximum(1, share))[y[fit]] * fit.sum() / len(names)
    target = np.where(np.arange(len(names)) == y[fit][:, None], 1.0, -1.0)
    bias = (w[:, None] * target).sum(axis=0) / w.sum()
    gram = (z[fit] * w[:, None]).T @ z[fit] + RIDGE * fit.sum() * np.eye(z.shape[1])
    beta = np.linalg.solve(gram, (z[fit] * w[:, None]).T @ (target - bias))

    def loss(steep: float) -> float:
        margin = steep * (z[check] @ beta + bias)
        margin -= margin.max(axis=1, keepdims=True)
        return float(-(margin[np.arange(len(margin)), y[check]] - np.log(np.exp(margin).sum(axis=1))).mean())

    steep = float(min(np.geomspace(0.5, 30, 30), key=loss)) if check.any() else 4.0
    return Model(names, marks, (root @ beta).astype(np.float32), bias.astype(np.float32), steep)


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("id"), folds) != held_out) & F.col("text").rlike(r"\p{L}"))
    ids = [(r.id,) for r in usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()]
    if not ids:
        return train([], [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence(t.as_py())).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["id", "lang", "bits"])

    chosen = usable.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "id long")), "id").select("id", "lang", "text")  # FIT_ROWS ids
    found = map_arrow(chosen, run, "id long, lang string, bits binary").groupBy(F.xxhash64("id").alias("h"), "id").agg(F.min(F.struct("lang", "bits")).alias("row"))
    rows = [r.row for r in found.orderBy("h", "id").collect()]
    return train([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, folds, held_out))  # LANDMARKS x CELLS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                names, scores = found.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
