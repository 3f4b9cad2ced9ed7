"""The tile index: vectors joined to tile metadata, checked on every way in, searched as one call.

An index is one table: tile_id, scene_id, modality, tile_directory, bounds_wgs84,
bounds_projected, crs, acquisition_datetime_utc, row_idx, col_idx, embedding. Rows are found by
tile_id; ``with_row_ids`` numbers them for those who want a position.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraquarry.functions.scalars import norm, parse_iso_datetime, rounded
from terraquarry.operators import search
from terraquarry.operators.tiling import affine_bounds

DIMENSION = 512
ENTRY = ["tile_id", "scene_id", "modality", "tile_directory", "bounds_wgs84", "bounds_projected", "crs", "acquisition_datetime_utc", "row_idx", "col_idx"]


def index_entries(embeddings: DataFrame, tiles: DataFrame) -> DataFrame:
    """Vectors (tile_id, scene_id, modality, embedding) with the metadata of their tiles; a vector without a tile keeps nulls.

    ``tiles`` may lack any metadata column. Of bounds that a tile lacks, those of its fit
    (``fit_coefficients``) take the place; an empty time counts as missing.
    """
    have = set(tiles.columns)
    kinds = {"bounds_wgs84": "array<double>", "bounds_projected": "array<double>", "fit_coefficients": "array<double>", "row_idx": "int", "col_idx": "int"}
    names = [*(c for c in ENTRY if c not in ("scene_id", "modality")), "acquisition_datetime", "fit_coefficients"]
    pick = lambda c: F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c)
    joined = embeddings.select("tile_id", "scene_id", "modality", "embedding").join(tiles.select(*(pick(c) for c in names)), "tile_id", "left")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    bounds = F.coalesce("bounds_wgs84", F.when(F.col("modality") == "sar", affine_bounds(F.col("fit_coefficients"))))
    out = joined.withColumn("bounds_wgs84", bounds).withColumn("acquisition_datetime_utc", F.coalesce(filled("acquisition_datetime_utc"), filled("acquisition_datetime")))
    return out.select(*ENTRY, "embedding")


def faults(index: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """One row: total, wrong_dimension, not_unit, without_id, repeated_ids, min_norm, max_norm."""
    own = F.size("embedding") == dimension
    length = F.when(own, norm(F.col("embedding")))
    counted = index.agg(
        F.count("*").alias("total"), F.count_if(~F.coalesce(own, F.lit(False))).alias("wrong_dimension"), F.count_if(F.abs(length - 1) > search.UNIT_TOLERANCE).alias("not_unit"),
        F.count_if(F.col("tile_id").isNull()).alias("without_id"), F.min(length).alias("min_norm"), F.max(length).alias("max_norm"),
    )
    repeated = index.where("tile_id IS NOT NULL").groupBy("tile_id").count().where("count > 1").agg(F.count("*").alias("repeated_ids"))
    return counted.crossJoin(F.broadcast(repeated))  # one row each


def checked(index: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """The index, if its vectors have the dimension and length 1 and its ids are there once; else a ValueError."""
    if dimension <= 0:
        raise ValueError("the dimension must be positive")
    row = faults(index, dimension).first()
    bad = {k: row[k] for k in ("wrong_dimension", "not_unit", "without_id", "repeated_ids") if row[k]}
    if bad:
        raise ValueError(f"not an index of unit vectors of dimension {dimension}: {bad}, norms {row.min_norm} to {row.max_norm}")
    return index


def add_vectors(index: DataFrame, more: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Both sets, checked together."""
    return checked(index.unionByName(more), dimension)


def save(index: DataFrame, path: str, dimension: int = DIMENSION) -> None:
    """Write a checked index, a folder for each modality."""
    checked(index, dimension).write.mode("error").partitionBy("modality").parquet(path)


def load(spark: SparkSession, path: str, dimension: int = DIMENSION, expected: int | None = None) -> DataFrame:
    """Read an index back; one that was tampered with, or hasn't ``expected`` rows, is a ValueError."""
    index = checked(spark.read.parquet(path), dimension)
    if expected is not None and (found := index.count()) != expected:
        raise ValueError(f"the index has {found} rows, not {expected}")
    return index


def with_row_ids(index: DataFrame) -> DataFrame:
    """Adds row_id from 0: radar before optical, then by scene, then by grid place and tile.

    Rows are numbered within scenes; scenes alone, one row each, are numbered in one task.
    """
    sizes = index.groupBy("modality", "scene_id").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("modality") == "optical", "modality", "scene_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("modality", "scene_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("modality", "scene_id").orderBy("row_idx", "col_idx", "tile_id")
    joined = index.withColumn("_at", F.row_number().over(inside)).join(starts, ["modality", "scene_id"])
    return joined.withColumn("row_id", F.col("_start") + F.col("_at") - 1).drop("_at", "_start")


def by_tile(index: DataFrame, tile_id: str) -> DataFrame:
    """A tile's row, or none."""
    return index.where(F.col("tile_id") == str(tile_id))


def by_row(index: DataFrame, row_id: int) -> DataFrame:
    """The row of a position in a numbered index; one that there isn't is an IndexError."""
    found = index.where(F.col("row_id") == row_id)
    if found.isEmpty():
        raise IndexError(row_id)
    return found


def group_counts(index: DataFrame) -> DataFrame:
    """Tiles by modality (scene null) and by scene (modality null)."""
    named = index.select(F.coalesce("modality", F.lit("unknown")).alias("modality"), F.coalesce("scene_id", F.lit("unknown")).alias("scene_id"))
    return named.groupingSets([["modality"], ["scene_id"]], "modality", "scene_id").agg(F.count("*").alias("n"))


def hits(index: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k best tiles: rank, tile_id, similarity_score, row_id, scene_id, modality, bounds_wgs84, tile_directory, acquisition_datetime_utc, metadata (JSON)."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    found = search.best(index, vector, k, id_col="tile_id")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "tile_id"))  # over k rows, by scores to 12 places as they were chosen
    position = F.col("row_id") if "row_id" in index.columns else F.lit(None).cast("long")
    rest = [c for c in index.columns if c != "embedding"]
    return found.select(rank.alias("rank"), "tile_id", rounded(F.col("score")).alias("similarity_score"), position.alias("row_id"), "scene_id", "modality", "bounds_wgs84", "tile_directory", "acquisition_datetime_utc", F.to_json(F.struct(*rest)).alias("metadata"))


class TextSearch:
    """Search of an index by text or vector; ``embedder`` turns text into a vector (see ``operators.embedding``)."""

    def __init__(self, index: DataFrame, embedder=None, dimension: int = DIMENSION):
        if embedder is not None and embedder.dimension != dimension:
            raise ValueError(f"the embedder has {embedder.dimension} dimensions, the index {dimension}")
        self.index, self.embedder, self.dimension = index, embedder, dimension

    @classmethod
    def open(cls, spark: SparkSession, path: str, embedder=None, dimension: int = DIMENSION) -> TextSearch:
        return cls(load(spark, path, dimension), embedder, dimension)

    @property
    def total_vectors(self) -> int:
        return self.index.count()

    def encode(self, text: str) -> list[float]:
        if not isinstance(text, str):
            raise TypeError(f"a query is text, not {type(text).__name__}")
        if not text.strip():
            raise ValueError("a query can't be empty")
        if self.embedder is None:
            raise ValueError("this search has no embedder: pass a vector")
        return search.checked_vector(self.embedder.encode_text(text.strip()), self.dimension)

    def search(self, query: str | np.ndarray, top_k: int = 10, modality: str | None = None, date_from=None, date_to=None, scene_id: str | None = None, bbox: Sequence[float] | None = None) -> DataFrame:
        """The k best tiles that meet all filters, as ``hits`` gives them. Filters come first, and reach the scan."""
        search.checked_k(top_k)
        if not isinstance(query, str | np.ndarray):
            raise TypeError(f"a query is text or an array, not {type(query).__name__}")
        tiles = self.index
        if date_from is not None or date_to is not None:
            tiles = tiles.withColumn("acquired", parse_iso_datetime(F.col("acquisition_datetime_utc")))
        corner = lambda i: F.when(F.size("bounds_wgs84") == 4, F.get("bounds_wgs84", F.lit(i)))
        if bbox is not None:
            tiles = tiles.withColumns({c: corner(i) for i, c in enumerate(("west", "south", "east", "north"))})
        tiles = search.metadata_filter(tiles, modality, date_from, date_to, scene_id, bbox)
        vector = self.encode(query) if isinstance(query, str) else search.checked_vector(query, self.dimension)
        return hits(tiles.select(*self.index.columns), vector, top_k)

    def like_tile(self, tile_id: str, top_k: int = 5) -> DataFrame:
        """The tiles nearest to a stored one, itself among them. An unknown tile is a KeyError."""
        row = by_tile(self.index, tile_id).select("embedding").first()
        if row is None:
            raise KeyError(tile_id)
        return hits(self.index, row[0], top_k)


def literal(vector: Sequence[float]) -> Column:
    """A vector as an array column."""
    return F.array(*(F.lit(float(x)) for x in vector))
