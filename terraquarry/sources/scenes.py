"""Scene folders as tables: metadata documents, their rasters, and what validates them.

A scene is a folder with metadata.json and a GeoTIFF for each band. ``optical_scenes`` and
``radar_scenes`` give two tables: scenes (a row each, with status, errors and warnings) and bands (a
row per band whose file is there).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquarry.operators.stats import array_statistics, class_report
from terraquarry.sources.geotiff import rasters
from terraquarry.sources.rasterfiles import at_windows

#: The bands that a scene must have, and the parts of a radar scene's provenance.
OPTICAL_BANDS, RADAR_BANDS = ("B02", "B03", "B04", "B08", "SCL"), ("VV", "VH")
PROVENANCE = ("tier1_copernicus_source", "tier2_aws_cog_distribution", "tier3_http_range_window_read", "tier4_local_native_radar_crop")
#: Limits above which a scene is flagged, not rejected.
BRIGHT_PERCENT, BRIGHT_MAX, CLOUD_PERCENT, CROP_BYTES = 5.0, 25_000.0, 10.0, 50 * 1024 * 1024

_BAND = "struct<local_filename:string,local_sha256:string,pixel_resolution_m:double,dimensions:struct<height:int,width:int>,source_asset_key:string,source_uri:string>"
_SCENE = (
    "scene_id:string,spacecraft:string,platform:string,sensor:string,processing_level:string,mgrs_tile:string,acquisition_datetime:string,acquisition_datetime_utc:string,"
    "cloud_cover_tile_pct:double,sun_elevation:double,sun_azimuth:double,instrument_mode:string,product_type:string,resolution_type:string,polarizations:array<string>,"
    "orbit_direction:string,relative_orbit:int,absolute_orbit:int,pixel_spacing_m:array<double>,effective_resolution_m:array<double>"
)
_GCP = "struct<id:string,source_col:double,source_row:double,local_col:double,local_row:double,lon:double,lat:double,elevation_m:double>"
_METADATA = f"scene_metadata struct<{_SCENE}>, bands map<string,{_BAND}>, crop_window struct<col_off:long,row_off:long,width:long,height:long>, local_gcps array<{_GCP}>, provenance map<string,string>"
#: What a scene's document may leave out.
_DEFAULTS = {
    "spacecraft": "Unknown", "platform": "Sentinel-1A", "processing_level": "Level-2A", "mgrs_tile": "43QBB", "instrument_mode": "IW", "product_type": "GRD",
    "resolution_type": "high", "orbit_direction": "descending", "relative_orbit": 34, "absolute_orbit": 0, "cloud_cover_tile_pct": 0.0, "sun_elevation": 0.0, "sun_azimuth": 0.0,
}


def documents(spark: SparkSession, path: str, name: str = "metadata.json") -> DataFrame:
    """JSON documents of one name at any depth: folder, json. Without any, reading is an error (as for a path that isn't there)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    if files.isEmpty():
        raise FileNotFoundError(f"no {name} under {path}")
    return files.select(F.substring_index("path", f"/{name}", 1).alias("folder"), F.col("content").cast("string").alias("json"))


def _loaded(spark: SparkSession, path: str, band_file) -> tuple[DataFrame, DataFrame]:
    parsed = documents(spark, path).select("folder", F.from_json("json", _METADATA).alias("m")).select("folder", "m.*")
    filled = parsed.select("*", *(F.coalesce(F.col(f"scene_metadata.{c}"), F.lit(v)).alias(c) for c, v in _DEFAULTS.items()))
    own = [c for c in (f.split(":")[0] for f in _SCENE.split(",") if ":" in f) if c not in _DEFAULTS and c not in ("acquisition_datetime", "acquisition_datetime_utc")]
    times = F.coalesce(F.nullif("scene_metadata.acquisition_datetime_utc", F.lit("")), "scene_metadata.acquisition_datetime")
    scenes = filled.select("folder", *(F.col(f"scene_metadata.{c}").alias(c) for c in own), *_DEFAULTS, times.alias("acquisition_datetime_utc"), "crop_window", "local_gcps", "provenance")
    listed = parsed.select("folder", F.col("scene_metadata.scene_id").alias("scene_id"), F.explode_outer("bands").alias("band", "recorded"))
    listed = listed.withColumn("filename", F.coalesce("recorded.local_filename", band_file(F.col("band"))))
    return scenes, listed.join(rasters(spark, path), ["folder", "filename"])  # a listed band whose file is missing has no row


def _named(rules: dict[str, Column], band: Column | None = None) -> Column:
    """The names of the rules that hold, each after its band."""
    name = lambda n: F.lit(n) if band is None else F.concat(band, F.lit(f": {n}"))
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name(n)) for n, rule in rules.items())))


def _verdicts(scenes: DataFrame, judged: DataFrame, expected: tuple[str, ...], extra: dict[str, Column]) -> DataFrame:
    gathered = judged.groupBy("folder").agg(
        F.collect_set("band").alias("_bands"), F.sort_array(F.flatten(F.collect_list("errors"))).alias("_errors"), F.sort_array(F.flatten(F.collect_list("warnings"))).alias("warnings"),
        F.count_distinct("height", "width").alias("_shapes"),
    )
    joined = scenes.join(gathered, "folder", "left").withColumn("_bands", F.coalesce("_bands", F.array().cast("array<string>")))
    missing = F.transform(F.filter(F.array(*map(F.lit, expected)), lambda b: ~F.array_contains("_bands", b)), lambda b: F.concat(F.lit("missing band "), b))
    none = F.array().cast("array<string>")
    out = joined.withColumn("errors", F.concat(missing, F.coalesce("_errors", none), _named(extra))).withColumn("warnings", F.coalesce("warnings", none))
    return out.withColumn("status", F.when(F.size("errors") == 0, "PASSED").otherwise("FAILED")).drop("_bands", "_errors", "_shapes")


def optical_scenes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenes and bands of optical folders. Bands carry statistics (for the class layer, class_report)."""
    scenes, bands = _loaded(spark, path, lambda b: F.concat(b, F.lit(".tif")))
    layer = F.col("band") == "SCL"
    stats = bands.withColumn("statistics", array_statistics(F.col("data"), F.col("nodata"))).withColumn("classes", F.when(layer, class_report(F.col("data"))))
    s, size = F.col("statistics"), F.col("recorded.dimensions")
    errors = {
        "crs": ~F.coalesce(F.col("crs"), F.lit("")).startswith("EPSG:"), "dimensions": (F.col("height") != size["height"]) | (F.col("width") != size["width"]),
        "resolution": F.abs(F.col("affine")[0] - F.col("recorded.pixel_resolution_m")) > 1e-4, "dtype": F.col("dtype") != F.when(layer, "uint8").otherwise("uint16"),
        "negative value": s["min"] < 0, "value too large": s["max"] > F.when(layer, 255.0).otherwise(65535.0), "sha256": ~F.col("sha256").eqNullSafe(F.col("recorded.local_sha256")),
    }
    warnings = {
        "nodata is not 0": ~layer & ~F.col("nodata").eqNullSafe(F.lit(0.0)), "bright pixels": ~layer & (s["n_above"] > 0) & ((s["pct_above"] > BRIGHT_PERCENT) | (s["max"] > BRIGHT_MAX)),
        "unknown class": layer & (s["max"] > 11), "clouds": layer & (F.col("classes.cloud_pct") > CLOUD_PERCENT),
    }
    judged = stats.withColumns({"errors": _named(errors, F.col("band")), "warnings": _named(warnings, F.col("band"))})
    return _verdicts(scenes, judged, OPTICAL_BANDS, {}), judged


def radar_scenes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenes and bands of radar folders."""
    scenes, bands = _loaded(spark, path, lambda b: F.concat(F.lower(b), F.lit(".tif")))
    stats = bands.withColumn("statistics", array_statistics(F.col("data"), F.col("nodata"))).join(scenes.select("folder", F.col("crop_window").alias("_crop")), "folder")
    s = F.col("statistics")
    errors = {
        "dimensions": (F.col("height") != F.col("_crop.height")) | (F.col("width") != F.col("_crop.width")), "dtype": F.col("dtype") != "uint16",
        "negative value": s["min"] < 0, "value too large": s["max"] > 65535, "sha256": ~F.col("sha256").eqNullSafe(F.col("recorded.local_sha256")),
    }
    judged = stats.withColumns({"errors": _named(errors, F.col("band")), "warnings": _named({"file larger than a crop": F.col("n_bytes") > CROP_BYTES}, F.col("band"))}).drop("_crop")
    moved = lambda g: (F.abs(g["local_col"] - g["source_col"] + F.col("crop_window.col_off")) > 1e-4) | (F.abs(g["local_row"] - g["source_row"] + F.col("crop_window.row_off")) > 1e-4)
    points = F.coalesce(F.size("local_gcps"), F.lit(-1))
    extra = {"bands of different shapes": F.col("_shapes") > 1, "no control points": points <= 0, "control points misplaced": F.exists("local_gcps", moved)}
    extra |= {f"provenance lacks {p}": ~F.coalesce(F.map_contains_key("provenance", F.lit(p)), F.lit(False)) for p in PROVENANCE}
    return _verdicts(scenes, judged, RADAR_BANDS, extra), judged


def unmodified(spark: SparkSession, path: str) -> DataFrame:
    """Per scene folder: whether every listed file is there with its recorded digest (one that has none recorded need only be there)."""
    listed = documents(spark, path).select("folder", F.from_json("json", _METADATA).alias("m")).select("folder", F.explode_outer("m.bands").alias("band", "b"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(path)
    hashed = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("now"))
    joined = listed.withColumn("name", F.col("b.local_filename")).join(hashed, ["folder", "name"], "left")
    good = F.col("name").isNull() | (F.col("now").isNotNull() & (F.coalesce(F.nullif("b.local_sha256", F.lit("")), "now") == F.col("now")))
    return joined.groupBy("folder").agg(F.bool_and(good).alias("unmodified"))


def tileable(scenes: DataFrame, bands: DataFrame, band: str) -> DataFrame:
    """Scenes with the size and georeferencing of one band, for the tile tables. A scene that failed its checks is an error."""
    bad = scenes.where("status <> 'PASSED'").select("scene_id", "errors").first()
    if bad is not None:
        raise ValueError(f"scene {bad.scene_id} failed its checks: {bad.errors}")
    head = bands.where(F.col("band") == band).select("folder", "height", "width", "crs", "affine")
    crop = {"crop_col_off": F.coalesce("crop_window.col_off", F.lit(0)), "crop_row_off": F.coalesce("crop_window.row_off", F.lit(0))}
    return scenes.join(head, "folder").withColumns(crop)


def cropped(bands: DataFrame, tiles: DataFrame, half: str | None = None, windows: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The rasters of tiles: tile_id, band, height, width, dtype, nodata, crs, affine, data, and the tiles' columns ``keep``. A band named ``half`` uses the halved windows.

    Bands meet the tiles of their scene by folder. With ``windows`` (the files are on a mounted
    file system) each tile reads the blocks of its own window, and no band's array is moved;
    else it takes slices of the array.
    """
    window = ["row_off", "col_off", "width", "height"]
    at = {c: F.when(F.col("band") == half, F.col(f"half_{c}")).otherwise(F.col(f"t_{c}")) if half else F.col(f"t_{c}") for c in window}
    named = tiles.select("folder", "tile_id", *keep, *(F.col(c).alias(f"t_{c}") for c in window), *(f"half_{c}" for c in window if half))
    array = [] if windows else [F.col("data").alias("_d")]
    joined = bands.select("folder", "path", "band", F.col("width").alias("_w"), "dtype", "nodata", "crs", F.col("affine").alias("_a"), *array).join(named, "folder").withColumns({f"w_{c}": v.cast("int") for c, v in at.items()})
    a = F.col("_a")
    moved = F.array(a[0], a[1], a[2] + a[0] * F.col("w_col_off"), a[3], a[4], a[5] + a[4] * F.col("w_row_off"))
    placed = joined.withColumn("affine", F.when(a.isNotNull(), moved))
    if windows:
        made = at_windows(placed.select("tile_id", "path", "band", "dtype", "nodata", "crs", "affine", *keep, *(f"w_{c}" for c in window)))
    else:
        rows = F.transform(F.sequence(F.col("w_row_off"), F.col("w_row_off") + F.col("w_height") - 1), lambda r: F.slice(F.col("_d"), r * F.col("_w") + F.col("w_col_off") + 1, F.col("w_width")))
        made = placed.withColumn("data", F.flatten(rows))
    return made.select("tile_id", "band", F.col("w_height").alias("height"), F.col("w_width").alias("width"), "dtype", "nodata", "crs", "affine", *keep, "data")
