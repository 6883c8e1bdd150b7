"""Document quality by random-indexing word vectors and a small calibrated network.

Every token (a run of letters, of digits or of other marks, as written) has a sparse random index
vector, a function of the token alone. A token's vector is the sum of the index vectors of its
neighbours, rotated by their offset, over the fitting texts, normalised and centred; the
``VOCABULARY`` most frequent tokens get one. All other tokens share one index vector, to which each
adds one of ``STRANGERS`` by its own hash. A document is pooled from the vectors of all its tokens:
their mean, their deviation in each dimension, and the mean product of neighbours, which shows how a
text repeats itself. Nothing else is seen of it. A network of two layers (numpy, Adam, seeded) is
trained on 4 of 5 of the fitting rows; on the fifth, one temperature is fitted that minimises the
log loss of its probabilities.

Fitting (bounded): the first ``FIT_ROWS`` labelled ids by hash, outside the held-out fold, train the
network; they are pooled on the executors. The first ``VECTOR_ROWS`` of them, as far as they hold
``VECTOR_CHARS`` characters together, give the word vectors. Scoring passes once over all whole texts.

Edge cases. Null or empty text: the vector of nothing, which still gets a score. Null doc_id: held
out is false, scored like others. Null labels are not learnt from; a document with both labels is
learnt once with each; of several texts of one id the least is learnt, so reruns agree. Ties by hash: by id. Very long texts:
pooled whole, in slices. Repeated rows: scored alike. No or one-sided labels: every score is the
share of label 1 (0.5 if there are none). Empty table: no rows. Columns other than doc_id and text
(in any case) are not read, whatever their names, and come back untouched from ``accepted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, map_arrow, place, release, remembered

FIT_ROWS, VECTOR_ROWS, VECTOR_CHARS, VOCABULARY = 6000, 1500, 12_000_000, 20_000
DIM, NONZERO, HIDDEN, STRANGERS = 64, 6, 32, 2048
POOLED = 3 * DIM
THRESHOLD = 0.3

_TOKEN = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")


def index_vector(word: str, dim: int = DIM) -> np.ndarray:
    """Sparse ternary vector, a function of the word alone."""
    out = np.zeros(dim, np.float32)
    bits = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"))
    for i in range(NONZERO):
        bits, at = divmod(bits, dim)
        bits, sign = divmod(bits, 2)
        out[at] += 2 * sign - 1
    return out


class Words(dict):
    """token -> row of its vector; frequent tokens are remembered."""

    def __init__(self, vocabulary: list[str], limit: int = 300_000):
        super().__init__((w, i) for i, w in enumerate(vocabulary))
        self.known, self.limit = len(vocabulary), limit

    def __missing__(self, token: str) -> int:
        value = self.known + xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % STRANGERS
        if len(self) < self.limit and len(token) <= 40:
            self[token] = value
        return value


class Pooler:
    """Vectors of whole texts."""

    def __init__(self, vocabulary: list[str], vectors: np.ndarray):
        self.words = Words(vocabulary)
        unit = 1 / np.sqrt(2 * NONZERO)
        strangers = [(index_vector("a stranger") + index_vector(f"stranger {i}")) * unit for i in range(STRANGERS)]
        self.vectors = np.vstack([vectors, np.asarray(strangers, np.float32)])

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(POOLED, np.float32)
        rows = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        total, squares, products = (np.zeros(DIM, np.float64) for _ in range(3))
        for i in range(0, len(rows), 20_000):
            v = self.vectors[rows[i : i + 20_001]]  # one more, whose product with its neighbour counts here
            products += np.einsum("td,td->d", v[:-1], v[1:])
            v = v[:20_000]
            total += v.sum(axis=0)
            squares += np.einsum("td,td->d", v, v)
        n = len(rows)
        mean = total / n
        return np.concatenate([mean, np.sqrt(np.maximum(0, squares / n - mean * mean)), products / n]).astype(np.float32)


def word_vectors(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The most frequent tokens of the texts and their random-indexing vectors."""
    lists = [_TOKEN.findall(x) for x in texts]
    counts = Counter(t for tokens in lists for t in tokens)
    vocabulary = [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if c > 1]
    if not vocabulary:
        return [], np.zeros((0, DIM), np.float32)
    place = {w: i for i, w in enumerate(vocabulary)}
    index = np.asarray([index_vector(w, DIM) for w in vocabulary] + [np.zeros(DIM)], np.float32)
    context = np.zeros((len(vocabulary) + 1, DIM), np.float32)
    stream = np.fromiter((place.get(t, -1) for tokens in lists for t in [*tokens, ""]), np.int64)
    for offset in (1, 2):
        for words, near, turn in ((stream[:-offset], stream[offset:], offset), (stream[offset:], stream[:-offset], -offset)):
            pair, times = np.unique(words * (len(vocabulary) + 1) + near, return_counts=True)
            pair, times = pair[pair >= 0], times[pair >= 0]
            a, b = np.divmod(pair, len(vocabulary) + 1)
            good = (a < len(vocabulary)) & (b < len(vocabulary))
            a, b, weight = a[good], b[good], np.log1p(times[good]).astype(np.float32)
            turned = np.roll(index, turn, axis=1)
            for i in range(0, len(a), 50_000):
                part = slice(i, i + 50_000)
                np.add.at(context, a[part], turned[b[part]] * weight[part, None])
    context = context[:-1]
    context /= np.maximum(1e-6, np.linalg.norm(context, axis=1, keepdims=True))
    weight = np.array([counts[w] for w in vocabulary], np.float32)
    return vocabulary, context - (weight / weight.sum()) @ context


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60) -> dict:
    """Weights of the two layers, the scaling of inputs and the temperature."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        return {"constant": share}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    cut = max(1, len(y) // 5)
    mean, std = x[cut:].mean(axis=0), x[cut:].std(axis=0) + 1e-3
    z = (x - mean) / std
    params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        places = cut + rng.permutation(len(y) - cut)
        for i in range(0, len(places), 128):
            rows = places[i : i + 128]
            a, b = z[rows], y[rows]
            h = np.tanh(a @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - b) / len(rows)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(z[:cut] @ params[0] + params[1]) @ params[2] + params[3]

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(y[:cut] * np.log(p) + (1 - y[:cut]) * np.log(1 - p)).mean())

    temperature = min(np.geomspace(0.5, 10, 60), key=loss)
    return {"layers": [p.astype(np.float32) for p in params], "mean": mean.astype(np.float32), "std": std.astype(np.float32), "temperature": float(temperature)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    a, b, c, d = model["layers"]
    logits = (np.tanh(((x - model["mean"]) / model["std"]) @ a + b) @ c + d).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logits / model["temperature"], -30, 30)))


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


Fitted = tuple[list[str], np.ndarray, dict]


def sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame | None:
    """at (0, 1, ... in order of hash), quality, text, n of the fitting rows, written; None without labels."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    chosen = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(FIT_ROWS).collect()
    if not chosen:
        return None
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, r.doc_id, r.quality) for i, r in enumerate(chosen)], "at int, id long, quality int"))  # FIT_ROWS rows
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(wanted, "id")
    return cut(found.groupBy("at", "quality").agg(F.min("text").alias("text")).withColumn("n", F.length("text")))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Fitted:
    """Vocabulary, its vectors and the network, from labelled rows outside the held-out fold."""
    rows = sample(docs, labels, folds, held_out)
    if rows is None:
        return [], np.zeros((0, DIM), np.float32), {"constant": 0.5}
    first, chars = [], 0
    for r in rows.select("at", "n").orderBy("at").limit(VECTOR_ROWS).collect():
        if chars + r.n <= VECTOR_CHARS:
            first.append(r.at)
            chars += r.n
    spark = docs.sparkSession
    texts = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in first], "at int")), "at").orderBy("at").select("text").collect() if first else []
    vocabulary, vectors = word_vectors([r.text for r in texts])
    shared = spark.sparkContext.broadcast((vocabulary, vectors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pooler(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pool(t.as_py()) for t in batch.column(2)], pa.list_(pa.float32()))], names=["at", "quality", "x"])

    pooled = sorted(map_arrow(rows.select("at", "quality", "text"), run, "at int, quality int, x array<float>").collect())
    release(rows)
    x = np.asarray([r.x for r in pooled], np.float32).reshape(len(pooled), POOLED)
    return vocabulary, vectors, train(x, np.asarray([r.quality for r in pooled]))


def _scorer(docs: DataFrame, fitted: Fitted):
    """A function of a column of texts that gives their scores, made once in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # at most VOCABULARY vectors

    def make():
        words, points, net = shared.value
        remembered("quality", dict)
        pool = Pooler(words, points)
        return lambda texts: predict(net, np.asarray([pool(t.as_py()) for t in texts], np.float32).reshape(len(texts), POOLED))

    return make


def score(docs: DataFrame, fitted: Fitted, key: str = "doc_id") -> DataFrame:
    """key, score for every row of docs."""
    scorer = _scorer(docs, fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)), pa.float64())], names=[key, "score"])

    return map_arrow(docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")), run, f"{key} long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = score(docs, fit(docs, labels, folds, held_out))
    held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    scorer, at = _scorer(docs, fit(docs, labels, folds, held_out)), place(docs, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= threshold))

    return map_arrow(docs, run, docs.schema)
