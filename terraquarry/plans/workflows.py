"""The stages of a collection's life as one call each: tile, embed, index, compare, export."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquarry.operators import detection, embedding, index, pairing, suppression, tiling
from terraquarry.sources import geotiff, rasterfiles, scenes, tables
from terraquarry.storage import stored


def _mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path is of a mounted file system, where tasks can read windows of files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def tile_optical(spark: SparkSession, path: str, tile: int = 256, stride: int | None = None, strategy: str = "shift") -> tuple[DataFrame, DataFrame]:
    """Tiles and their rasters (with content, n_bytes, sha256, statistics) of the optical scenes under a path. A scene that fails its checks is an error."""
    found, bands = scenes.optical_scenes(spark, path)
    tiles = tiling.optical_tiles(scenes.tileable(found, bands, "B02"), tile, stride, strategy)
    return tiles, _rasters(scenes.cropped(bands, tiles, half="SCL", windows=_mounted(spark, path)))


def tile_radar(spark: SparkSession, path: str, tile: int = 256, stride: int | None = None, strategy: str = "shift") -> tuple[DataFrame, DataFrame]:
    """The same for radar scenes; the rasters have their tile's control points (``gcps``), and so have the files."""
    found, bands = scenes.radar_scenes(spark, path)
    tiles = tiling.radar_tiles(scenes.tileable(found, bands, "VV").drop("crs", "affine"), tile, stride, strategy)
    points = F.transform("tile_gcps", lambda g: F.struct(g["tile_col"].alias("col"), g["tile_row"].alias("row"), g["lon"].alias("lon"), g["lat"].alias("lat"), g["elevation_m"].alias("elevation_m")))
    return tiles, _rasters(scenes.cropped(bands, tiles.withColumn("gcps", points), windows=_mounted(spark, path), keep=["gcps"]))


def _rasters(rows: DataFrame) -> DataFrame:
    from terraquarry.operators.stats import array_statistics

    return geotiff.encoded(rows).withColumn("statistics", array_statistics(F.col("data"), F.col("nodata")))


def headers_and_pixels(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``detection`` compares, of tile rasters."""
    shaped = rasters.withColumn("shape", F.array("height", "width"))
    return shaped.select("tile_id", "band", "shape", "crs", "affine", "nodata"), detection.from_arrays(shaped.select("tile_id", "band", "shape", "data"))


def images(tiles: DataFrame, rasters: DataFrame) -> DataFrame:
    """Tiles as RGB images for an embedder: tile_id, scene_id, modality, image (height, width, data)."""
    bands = rasters.groupBy("tile_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "data"))).alias("b"), F.max("height").alias("height"), F.max("width").alias("width"))
    joined = tiles.select("tile_id", "scene_id", "modality").join(bands, "tile_id")
    band = lambda n: F.col("b")[n]
    byte = lambda x: x.cast("int")
    optical = F.flatten(F.transform(F.arrays_zip(band("B04").alias("r"), band("B03").alias("g"), band("B02").alias("b")), lambda p: F.array(*(byte(tiling.optical_scale(p[c])) for c in "rgb"))))
    levels = F.transform(F.arrays_zip(band("VV").alias("vv"), band("VH").alias("vh")), lambda p: tiling.radar_levels(p["vv"].cast("double"), p["vh"].cast("double")))
    radar = F.flatten(F.transform(levels, lambda p: F.transform(p, lambda x: byte(F.bround(x * 255.0, 0)))))
    return joined.select("tile_id", "scene_id", "modality", "height", "width", F.when(F.col("modality") == "optical", optical).otherwise(radar).alias("values"))


def embed_tiles(tiles: DataFrame, rasters: DataFrame, embedder: embedding.Embedder, batch_size: int = 32) -> DataFrame:
    """(tile_id, scene_id, modality, embedding) of tiles."""
    rows = images(tiles, rasters).withColumn("image", F.struct("height", "width", F.unhex(F.array_join(F.transform("values", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")).alias("data")))
    found = embedding.embed(rows, embedder, "image", "tile_id", batch_size, images=True)
    return tiles.select("tile_id", "scene_id", "modality").join(found, "tile_id")


def build_index(embeddings: DataFrame, tiles: DataFrame, dimension: int = index.DIMENSION) -> DataFrame:
    """A checked, numbered index of vectors and tiles (of ``tile_optical`` and ``tile_radar``, united with missing columns null)."""
    return index.with_row_ids(index.checked(index.index_entries(embeddings, tiles), dimension))


def index_of_folders(spark: SparkSession, embeddings_path: str, tiles: DataFrame, dimension: int = index.DIMENSION) -> DataFrame:
    """The same of staged embedding manifests."""
    return build_index(tables.staged_embeddings(spark, embeddings_path), tiles, dimension)


def index_tiles(tiles: DataFrame, directory: str) -> DataFrame:
    """The columns of tiles that an index takes: their folder below ``directory``, and a fit's coefficients."""
    out = tiles.withColumn("tile_directory", F.concat_ws("/", F.lit(directory), "scene_id", "tile_id"))
    return out.withColumn("fit_coefficients", F.col("fit.coefficients")) if "fit" in tiles.columns else out


def compare(tiles: DataFrame, rasters: DataFrame, pairs: DataFrame | None = None, change: detection.ChangeConfig = detection.ChangeConfig(), limits: suppression.SuppressionConfig = suppression.SuppressionConfig()) -> dict[str, DataFrame]:
    """Pairs (all of an index's tiles, unless given), changes (with their magnitude rasters), suppressed results and candidates.

    The comparison is made once, when this is called, and lies in the shared folder; each of
    the tables reads its own columns of it.
    """
    pairs = pairing.all_tile_pairs(tiles) if pairs is None else pairs
    found = stored(detection.compare_rasters(pairs, rasters.select("tile_id", "band", "height", "width", "crs", "affine", "nodata", "data"), change, limits), "compared")
    verdict = ("status", "method", "warnings")
    suppressed = found.drop("magnitude", *verdict).select("*", "suppressed.*").drop("suppressed", "pixels")
    candidates = found.select("pair_id", F.inline("suppressed.pixels"))
    return {"pairs": pairs, "changes": found.drop("suppressed"), "suppressed": suppressed, "candidates": candidates}


def change_maps(changes: DataFrame, headers: DataFrame, band: str = "B02") -> DataFrame:
    """Magnitude rasters of compared pairs, to be written as files: name, height, width, dtype, crs, affine, nodata, data. Invalid pixels are NaN."""
    return _maps(changes.where("magnitude IS NOT NULL").select("pair_id", "reference_tile_id", F.col("magnitude").alias("data")), headers, band, "change", "float32", float("nan"))


def stored_magnitudes(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, magnitude) of the magnitude files that ``change_maps`` has made under a path."""
    files = geotiff.rasters(spark, path, "change__*.tif")
    return files.select(F.regexp_extract("filename", r"^change__(.*)\.tif$", 1).alias("pair_id"), F.col("data").alias("magnitude"))


def confirmed_maps(changes: DataFrame, candidates: DataFrame, headers: DataFrame, band: str = "B02") -> DataFrame:
    """Masks (bytes) and confidences (floats) of confirmed pixels, as above; a compared pair without any has empty ones."""
    side = detection.SIDE
    sure = candidates.where("area IS NOT NULL").groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") * side + F.col("c")).cast("int").alias("at"), "confidence"))).alias("sure"))
    pairs = changes.where("status = 'success'").select("pair_id", "reference_tile_id").join(sure, "pair_id", "left")

    def filled(batches):
        for batch in batches:
            grid = np.zeros((batch.num_rows, side * side), np.float32)
            for i, pixels in enumerate(batch.column("sure").to_pylist()):
                if pixels:
                    at, values = zip(*pixels, strict=True)
                    grid[i, list(at)] = values
            data = pa.array(list(grid), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), batch.column("reference_tile_id"), data], names=["pair_id", "reference_tile_id", "data"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("pair_id", "reference_tile_id"))
    grids = pairs.mapInArrow(filled, f"{kinds}, data array<float>")
    mask = grids.withColumn("data", F.transform("data", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float")))
    return _maps(mask, headers, band, "mask", "uint8", 0.0).unionByName(_maps(grids, headers, band, "confidence", "float32", 0.0))


def _maps(grids: DataFrame, headers: DataFrame, band: str, prefix: str, dtype: str, nodata: float) -> DataFrame:
    placed = headers.where(F.col("band") == band).select(F.col("tile_id").alias("reference_tile_id"), "crs", "affine")
    side = F.lit(detection.SIDE)
    name = F.concat(F.lit(f"{prefix}__"), "pair_id", F.lit(".tif"))
    return grids.join(placed, "reference_tile_id", "left").select(name.alias("name"), side.alias("height"), side.alias("width"), F.lit(dtype).alias("dtype"), "crs", "affine", F.lit(nodata).alias("nodata"), "data")


def write_tile_files(tiles: DataFrame, rasters: DataFrame, path: str, block: int = 256) -> None:
    """The tiles' rasters as blocked files, modality/scene/tile/band.tif below a path (a mounted one), all or none; radar files carry their control points."""
    place = F.concat_ws("/", "modality", "scene_id", "tile_id", F.concat("band", F.lit(".tif")))
    rows = rasters.join(tiles.select("tile_id", "modality", "scene_id"), "tile_id").withColumn("name", place)
    kept = ["name", "height", "width", "dtype", "crs", "affine", "nodata", "data", *["gcps"] * ("gcps" in rasters.columns)]
    rasterfiles.write_rasters(rows.select(*kept), path, block)


def write_tiles(tiles: DataFrame, rasters: DataFrame, path: str) -> None:
    """Tile rows, rasters and manifests as Parquet below a path, by modality and scene where that prunes."""
    tiles.write.mode("error").partitionBy("modality").parquet(f"{path}/tiles")
    rasters.join(tiles.select("tile_id", "modality", "scene_id"), "tile_id").write.mode("error").partitionBy("modality", "scene_id").parquet(f"{path}/rasters")
    sized = tiles.join(rasters.groupBy("tile_id").agg(F.sum("n_bytes").alias("tile_bytes")), "tile_id", "left")
    tiling.manifests(sized, "tile_bytes").write.mode("error").parquet(f"{path}/manifests")
