"""Embedders: what a model must offer, tables of vectors made with one, and one without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type


class Embedder(Protocol):
    """A model, pickled to the workers; one that is heavy should load itself there at its first use."""

    dimension: int
    metadata: dict

    def encode_texts(self, texts: Sequence[str]) -> np.ndarray: ...

    def encode_images(self, images: Sequence[np.ndarray]) -> np.ndarray: ...


def unit_rows(vectors: np.ndarray, dimension: int) -> np.ndarray:
    """Rows scaled to length 1; another shape, or a zero row, is an error."""
    vectors = np.asarray(vectors, float)
    if vectors.ndim != 2 or vectors.shape[1] != dimension:
        raise ValueError(f"an embedder gave the shape {vectors.shape}, not (n, {dimension})")
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    if not (lengths > 0).all():
        raise ValueError("an embedder gave a zero vector")
    return (vectors / lengths).astype(np.float32)


class HashEmbedder:
    """Vectors that depend on the bytes alone, for tests and dry runs: equal inputs have equal vectors."""

    def __init__(self, dimension: int = 512):
        self.dimension, self.metadata = dimension, {"model_name": "hash", "embedding_dim": dimension}

    def _vector(self, data: bytes) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")
        return np.random.default_rng(seed).standard_normal(self.dimension)

    def encode_texts(self, texts: Sequence[str]) -> np.ndarray:
        return unit_rows(np.array([self._vector(t.encode()) for t in texts]).reshape(-1, self.dimension), self.dimension)

    def encode_images(self, images: Sequence[np.ndarray]) -> np.ndarray:
        return unit_rows(np.array([self._vector(np.ascontiguousarray(i).tobytes()) for i in images]).reshape(-1, self.dimension), self.dimension)

    def encode_text(self, text: str) -> np.ndarray:
        return self.encode_texts([text])[0]


def rgb_array(image) -> np.ndarray:
    """Rows by columns by 3 bytes of an array: gray is repeated, channels that come first are moved last, values are clipped."""
    array = np.asarray(image)
    if array.ndim == 2:
        array = np.stack([array] * 3, -1)
    elif array.ndim == 3 and array.shape[0] == 3 and array.shape[2] != 3:
        array = np.moveaxis(array, 0, -1)
    if array.ndim != 3 or array.shape[2] < 3:
        raise ValueError(f"not an image: {array.shape}")
    return (array if array.dtype == np.uint8 else np.clip(array, 0, 255).astype(np.uint8))[:, :, :3]


def embed(rows: DataFrame, embedder: Embedder, column: str, id_col: str, batch_size: int = 64, images: bool = False) -> DataFrame:
    """(id, embedding) of a text column, or of one of images (height, width, data: RGB bytes row by row); null values have no row.

    One embedder for each task, fed ``batch_size`` rows at a time.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    kind = rows.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                values = part.column(1).to_pylist()
                if images:
                    values = [rgb_array(np.frombuffer(v["data"], np.uint8).reshape(v["height"], v["width"], 3)) for v in values]
                vectors = unit_rows((embedder.encode_images if images else embedder.encode_texts)(values), embedder.dimension)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow), pa.array(list(vectors), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return rows.where(rows[column].isNotNull()).select(id_col, column).mapInArrow(run, f"{id_col} {kind.simpleString()}, embedding array<float>")
