"""Sources and sinks: everything goes through Spark's readers and writers, so any store that Spark reads will do."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Scene and tile manifests: JSON documents, one a file, found at any depth."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The SHA-256 and size of each file under a path: (path, sha256, n_bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def write_index(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write an index of tiles, partitioned by a column of few values for pruning."""
    writer = df.write.mode("error")
    (writer.partitionBy(by) if by else writer).parquet(path)


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the NumPy matrices under a path: folder, filename, at (from 0), embedding. A file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.load(io.BytesIO(row["content"]), allow_pickle=False)
                if matrix.ndim != 2:
                    raise ValueError(f"{row['path']}: not a matrix but {matrix.shape}")
                folder, _, name = row["path"].rpartition("/")
                n = len(matrix)
                yield pa.RecordBatch.from_arrays([pa.array([folder] * n), pa.array([name] * n), pa.array(np.arange(n)), pa.array(list(matrix.astype(np.float32)), pa.list_(pa.float32()))], names=["folder", "filename", "at", "embedding"])

    return files.mapInArrow(run, "folder string, filename string, at long, embedding array<float>")


def staged_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of embedding manifests (manifest.json beside a matrix): tile_id, scene_id, modality, embedding.

    A manifest whose matrix is missing is a FileNotFoundError, one that lists another number of tiles a ValueError.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(path)
    schema = "source_scene_id string, modality string, embeddings_file string, tile_ids array<string>"
    found = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.from_json(F.col("content").cast("string"), schema).alias("m")).select("folder", "m.*")
    if found.isEmpty():
        raise FileNotFoundError(f"no manifest.json under {path}")
    rows = npy_rows(spark, path)
    listed = found.select("folder", F.col("embeddings_file").alias("filename"), F.col("source_scene_id").alias("scene_id"), "modality", "tile_ids")
    counts = listed.join(rows.groupBy("folder", "filename").agg(F.count("*").alias("n")), ["folder", "filename"], "left")
    bad = counts.where("n IS NULL OR n <> size(tile_ids)").first()
    if bad is not None and bad.n is None:
        raise FileNotFoundError(f"{bad.folder}/{bad.filename}")
    if bad is not None:
        raise ValueError(f"{bad.folder}: {bad.n} vectors, {len(bad.tile_ids)} tiles")
    named = listed.select("folder", "filename", "scene_id", "modality", F.posexplode("tile_ids").alias("at", "tile_id"))
    return named.join(rows, ["folder", "filename", "at"]).select("tile_id", "scene_id", "modality", "embedding")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path: path, n_bytes. Their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"))


#: Endings of files that hold a model's weights.
WEIGHTS = ("bin", "safetensors", "msgpack", "pt")


def staged_model(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_files, n_bytes, megabytes (to 2 places) and whether a weight file is among them."""
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    found = sizes(spark, path).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.bool_or(ending.isin(*WEIGHTS)), F.lit(False)).alias("staged"))
    return found.withColumn("megabytes", F.round(F.col("n_bytes") / 1048576.0, 2))
