"""Text vectors: a pluggable model, by default feature hashing (for tests and as a stand-in)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def hashing(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of signed, hashed tokens."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    return model


def embed(items: DataFrame, key: str, dim: int, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """key, embedding for (key, text); the model sees Arrow batches."""
    model = model or hashing(dim)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model(batch.column(1).to_pylist()).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dim), pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[key, "embedding"])

    return items.select(items[key].cast("long").alias(key), "text").mapInArrow(run, f"{key} long, embedding array<float>")


def pack(vector: Iterable[float]) -> bytes:
    """A vector as little-endian 32-bit floats, as other stores keep them."""
    return np.asarray(list(vector), "<f4").tobytes()


def unpack(blob: bytes) -> list[float]:
    return np.frombuffer(blob, "<f4").tolist()
