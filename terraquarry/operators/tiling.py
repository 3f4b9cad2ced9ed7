"""Tile grids, georeferencing of tiles, ground control points and display scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The margin around a window within which control points are kept, in pixels.
GCP_MARGIN = 1200.0
#: Digital numbers per unit of reflectance, and the reflectance shown as white.
REFLECTANCE_SCALE, VISUAL_MAX = 10000.0, 0.35
#: log10 amplitudes of the two polarizations that are shown as white.
LOG_VV_MAX, LOG_VH_MAX = 3.6, 3.2
#: Metres of a degree of latitude and of longitude, for residuals of fits.
METRES_PER_LAT, METRES_PER_LON = 110691.77, 105307.72
STRATEGIES = ("shift", "truncate", "pad")


def axis_offsets(dim: Column, tile: int, stride: int | None = None, strategy: str = "shift") -> Column:
    """Where the tiles of an axis start and how long they are: an array of (off, len).

    Whole tiles come every ``stride`` pixels. If the next one would start before the axis ends,
    what it would cover is given to a tile shifted back to the end, a shorter tile, or a padded
    one. An axis no longer than a tile has one tile. A size that isn't positive is an error.
    """
    stride = tile if stride is None else stride
    if tile <= 0 or stride <= 0 or strategy not in STRATEGIES:
        raise ValueError("tile and stride are positive; strategy is shift, truncate or pad")
    size, dim = F.lit(tile).cast("long"), dim.cast("long")
    piece = lambda off, length: F.struct(off.cast("long").alias("off"), length.cast("long").alias("len"))
    starts = F.sequence(F.lit(0).cast("long"), dim - size, F.lit(stride).cast("long"))
    following = F.element_at(starts, -1) + stride
    last = {"shift": piece(dim - size, size), "truncate": piece(following, dim - following), "pad": piece(following, size)}[strategy]
    more = following < dim
    if strategy == "shift":
        more &= F.element_at(starts, -1) != dim - size
    whole = F.transform(starts, lambda s: piece(s, size))
    one = F.array(piece(F.lit(0), size if strategy == "pad" else dim))
    found = F.when(dim <= size, one).when(more, F.concat(whole, F.array(last))).otherwise(whole)
    return F.when(dim <= 0, F.raise_error(F.lit("an axis must have a positive size"))).otherwise(found)


def tile_windows(scenes: DataFrame, tile: int = 256, stride: int | None = None, strategy: str = "shift") -> DataFrame:
    """One row per tile of scenes (scene_id, width, height), rows first: its grid place, offset and size. No shuffle."""
    y = scenes.select("scene_id", F.posexplode(axis_offsets(F.col("height"), tile, stride, strategy)).alias("row_idx", "y"), "width")
    x = y.select("scene_id", "row_idx", "y", F.posexplode(axis_offsets(F.col("width"), tile, stride, strategy)).alias("col_idx", "x"))
    return x.select("scene_id", "row_idx", "col_idx", F.col("y.off").alias("row_off"), F.col("x.off").alias("col_off"), F.col("x.len").alias("width"), F.col("y.len").alias("height"))


def optical_tile_id(scene: Column, row: Column, col: Column) -> Column:
    return F.format_string("s2_%s_10m_r%02d_c%02d", scene, row, col)


def radar_tile_id(scene: Column, row: Column, col: Column) -> Column:
    return F.format_string("s1_%s_radar_r%02d_c%02d", scene, row, col)


def half_window(tiles: DataFrame) -> DataFrame:
    """Adds the window on a grid of half the resolution: offsets and sizes halved, rounded down."""
    return tiles.withColumns({f"half_{c}": F.expr(f"{c} div 2") for c in ("col_off", "row_off", "width", "height")})


def absolute_window(tiles: DataFrame, crop_col_off: Column, crop_row_off: Column) -> DataFrame:
    """Adds the window's place in the scene that the tiled crop was taken from."""
    return tiles.withColumns({"abs_col_off": crop_col_off + F.col("col_off"), "abs_row_off": crop_row_off + F.col("row_off")})


def crop_pixels(pixels: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, r, c, ...) of each window (keys, row_off, col_off, width, height, ...), moved to its origin.

    The join is on the keys and cells of the windows' largest size, so that a scene's pixels meet
    few windows each; pixels in no window are left out, and those in several come several times.
    """
    cell = 256
    span = lambda off, size: F.explode(F.sequence(F.expr(f"{off} div {cell}"), F.expr(f"({off} + {size} - 1) div {cell}")))
    some = windows.withColumn("cell_r", span("row_off", "height")).withColumn("cell_c", span("col_off", "width"))
    placed = pixels.withColumn("cell_r", F.expr(f"r div {cell}")).withColumn("cell_c", F.expr(f"c div {cell}"))
    met = placed.join(some, [*keys, "cell_r", "cell_c"])
    inside = F.col("r").between(F.col("row_off"), F.expr("row_off + height - 1")) & F.col("c").between(F.col("col_off"), F.expr("col_off + width - 1"))
    return met.where(inside).withColumns({"r": F.col("r") - F.col("row_off"), "c": F.col("c") - F.col("col_off")}).drop("cell_r", "cell_c")


def tile_affine(affine: Column, col_off: Column, row_off: Column) -> Column:
    """The affine transform (a, b, c, d, e, f) of a window of a raster that has ``affine``."""
    a, b, c, d, e, f = (affine[i] for i in range(6))
    return F.array(a, b, c + a * col_off + b * row_off, d, e, f + d * col_off + e * row_off)


def projected_bounds(affine: Column, width: Column, height: Column) -> Column:
    """left, bottom, right, top of a raster without rotation."""
    return F.array(affine[2], affine[5] + height * affine[4], affine[2] + width * affine[0], affine[5])


# ---------------------------------------------------------------- projections

_RADIUS, _FLATTENING, _SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLATTENING / (2 - _FLATTENING)
_MERIDIAN = _RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the inverse transverse Mercator series to the third order.
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
#: Segments of each side of a box whose bounds are projected.
SEGMENTS = 22


def utm_to_degrees(east: Column, north: Column, zone: Column, south: Column) -> Column:
    """Longitude and latitude (WGS84) of a point in a UTM zone, by the inverse series: (lon, lat)."""
    xi = (north - F.when(south, 1e7).otherwise(0.0)) / (_SCALE * _MERIDIAN)
    eta = (east - 500000.0) / (_SCALE * _MERIDIAN)
    xi_, eta_ = xi, eta
    for j, beta in enumerate(_BETA, 1):
        xi_ = xi_ - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi
    for j, delta in enumerate(_DELTA, 1):
        lat = lat + delta * F.sin(2 * j * chi)
    lon = zone * 6.0 - 183.0 + F.atan2(F.sinh(eta_), F.cos(xi_)) * (180 / math.pi)
    return F.struct(lon.alias("lon"), (lat * (180 / math.pi)).alias("lat"))


def wgs84_bounds(crs: Column, bounds: Column) -> Column:
    """west, south, east, north of a projected box (left, bottom, right, top); null for other systems than UTM and degrees.

    Sides are cut into segments, since a straight side is no parallel or meridian.
    """
    code = F.try_to_number(F.regexp_extract(F.upper(F.trim(crs)), r"^EPSG:(\d{4,5})$", 1), F.lit("99999")).cast("int")
    zone, south = code % 100, F.expr("1 = 0") | (F.floor(code / 100) == 327)
    known = F.floor(code / 100).isin(326, 327) & zone.between(1, 60)
    steps = F.sequence(F.lit(0), F.lit(SEGMENTS))
    between = lambda a, b: F.transform(steps, lambda i: a + (b - a) * i / SEGMENTS)
    left, bottom, right, top = (bounds[i] for i in range(4))
    point = lambda e, n: utm_to_degrees(e, n, zone, south)
    sides = F.concat(
        F.transform(between(left, right), lambda e: point(e, bottom)), F.transform(between(left, right), lambda e: point(e, top)),
        F.transform(between(bottom, top), lambda n: point(left, n)), F.transform(between(bottom, top), lambda n: point(right, n)),
    )
    lon, lat = F.transform(sides, lambda p: p["lon"]), F.transform(sides, lambda p: p["lat"])
    return F.when(code == 4326, bounds).when(known, F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)))


# ---------------------------------------------------------------- control points


def translate_gcps(gcps: Column, col_off: Column, row_off: Column, width, height, margin: float = GCP_MARGIN) -> Column:
    """Points (source_col, source_row, ...) within a margin of the window, with their place from its origin added."""
    inside = lambda g: (
        g["source_col"].between(col_off - margin, col_off + width + margin) & g["source_row"].between(row_off - margin, row_off + height + margin)
    )
    return F.transform(F.filter(gcps, inside), lambda g: g.withField("local_col", g["source_col"] - col_off).withField("local_row", g["source_row"] - row_off))


def tile_gcps(gcps: Column, col_off: Column, row_off: Column) -> Column:
    """All points (local_col, local_row, ...) of a crop with their place from a tile's origin added."""
    return F.transform(gcps, lambda g: g.withField("tile_col", g["local_col"] - col_off).withField("tile_row", g["local_row"] - row_off))


def local_affine(gcps: Column, x: str = "local_col", y: str = "local_row") -> Column:
    """Least squares of lon and lat on two columns of an array of points, without a shuffle.

    A struct: coefficients (a, b, c of lon = a x + b y + c, then those of lat), rmse_metres
    (rounded to 2 places) and gcp_count. Fewer than three points, or points on a line, give zeros.
    """
    n = F.size(gcps)
    total = lambda f: F.aggregate(gcps, F.lit(0.0), lambda s, g: s + f(g))
    mean = {k: F.try_divide(total(lambda g, k=k: g[k]), n) for k in (x, y, "lon", "lat")}
    moments = F.struct(*(v.alias(k) for k, v in mean.items()))
    mixed = lambda m, i, j: total(lambda g: (g[i] - m[i]) * (g[j] - m[j]))
    # a lambda's variable is computed once
    stage = lambda value, f: F.transform(F.array(value), f)[0]
    sums = lambda m: F.struct(
        m.alias("m"), mixed(m, x, x).alias("xx"), mixed(m, y, y).alias("yy"), mixed(m, x, y).alias("xy"),
        *(mixed(m, i, z).alias(f"{k}_{z}") for k, i in (("x", x), ("y", y)) for z in ("lon", "lat")),
    )

    def solved(s: Column) -> Column:
        det = s["xx"] * s["yy"] - s["xy"] * s["xy"]
        out = []
        for z in ("lon", "lat"):
            a = F.try_divide(s[f"x_{z}"] * s["yy"] - s[f"y_{z}"] * s["xy"], det)
            b = F.try_divide(s[f"y_{z}"] * s["xx"] - s[f"x_{z}"] * s["xy"], det)
            out += [a, b, s["m"][z] - a * s["m"][x] - b * s["m"][y]]
        return F.array(*out)

    def judged(c: Column) -> Column:
        error = lambda g, at, z: c[at] * g[x] + c[at + 1] * g[y] + c[at + 2] - g[z]
        square = total(lambda g: F.pow(error(g, 0, "lon") * METRES_PER_LON, F.lit(2)) + F.pow(error(g, 3, "lat") * METRES_PER_LAT, F.lit(2)))
        good = (n >= 3) & c[0].isNotNull()
        zero = F.array(*([F.lit(0.0)] * 6))
        return F.struct(F.when(good, c).otherwise(zero).alias("coefficients"), F.when(good, F.round(F.sqrt(F.try_divide(square, n)), 2)).otherwise(0.0).alias("rmse_metres"), n.alias("gcp_count"))

    return stage(stage(stage(moments, sums), solved), judged)


def affine_bounds(coefficients: Column, size: int = 256) -> Column:
    """west, south, east, north of a tile's corners under a fit of lon and lat, to 6 places; null without one."""
    corners = [(0, 0), (size, 0), (size, size), (0, size)]
    at = lambda k: [coefficients[k] * i + coefficients[k + 1] * j + coefficients[k + 2] for i, j in corners]
    lon, lat = at(0), at(3)
    return F.when(F.size(coefficients) == 6, F.array(*(F.round(f(*v), 6) for f, v in ((F.least, lon), (F.least, lat), (F.greatest, lon), (F.greatest, lat)))))


# ---------------------------------------------------------------- display


def _clip(x: Column, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(high))


def optical_scale(dn: Column, scale: float = REFLECTANCE_SCALE, high: float = VISUAL_MAX) -> Column:
    """Digital numbers to display bytes: clipped reflectance, rounded half to even."""
    return F.bround(_clip(dn / scale, min(1.0, high)) / high * 255.0, 0).cast("int")


def optical_rgb(pixels: DataFrame, red: str = "B04", green: str = "B03", blue: str = "B02") -> DataFrame:
    """Pixels with three bands as display bytes: red, green, blue added."""
    return pixels.withColumns({n: optical_scale(F.col(b)) for n, b in (("red", red), ("green", green), ("blue", blue))})


def radar_levels(vv: Column, vh: Column) -> Column:
    """Log amplitudes of two polarizations and their mean, each 0 to 1; negative amplitudes count as 0."""
    level = lambda x, high: _clip(F.log10(1.0 + F.greatest(x, F.lit(0.0))) / high)
    a, b = level(vv, LOG_VV_MAX), level(vh, LOG_VH_MAX)
    return F.array(a, b, _clip(0.5 * (a + b)))


def radar_rgb(pixels: DataFrame, vv: str = "VV", vh: str = "VH") -> DataFrame:
    """Pixels with two polarizations as display bytes of a false-colour image: red, green, blue added."""
    levels = radar_levels(F.col(vv).cast("double"), F.col(vh).cast("double"))
    return pixels.withColumn("_levels", levels).withColumns({n: F.bround(F.col("_levels")[i] * 255.0, 0).cast("int") for i, n in enumerate(("red", "green", "blue"))}).drop("_levels")


# ---------------------------------------------------------------- tile tables


def optical_tiles(scenes: DataFrame, tile: int = 256, stride: int | None = None, strategy: str = "shift") -> DataFrame:
    """Tile rows of valid optical scenes: scene_id, width, height, crs, affine, acquired_utc and others.

    Adds tile_id, the window, the half-resolution window of the class layer, affine,
    bounds_projected and bounds_wgs84. Other columns of the scene are kept. No shuffle.
    """
    others = [c for c in scenes.columns if c not in ("width", "height")]
    windows = _windowed(scenes, others, tile, stride, strategy)
    placed = windows.withColumn("tile_id", optical_tile_id(F.col("scene_id"), F.col("row_idx"), F.col("col_idx")))
    placed = half_window(placed).withColumn("affine", tile_affine(F.col("affine"), F.col("col_off"), F.col("row_off")))
    placed = placed.withColumn("bounds_projected", projected_bounds(F.col("affine"), F.col("width"), F.col("height")))
    return placed.withColumns({"modality": F.lit("optical"), "bounds_wgs84": wgs84_bounds(F.col("crs"), F.col("bounds_projected"))})


def radar_tiles(scenes: DataFrame, tile: int = 256, stride: int | None = None, strategy: str = "shift") -> DataFrame:
    """Tile rows of valid radar scenes: scene_id, width, height, crop_col_off, crop_row_off, local_gcps and others.

    Adds tile_id, the window, its absolute place, all control points from the tile's origin, the
    fitted affine and the bounds that follow from it. Other columns are kept. No shuffle.
    """
    others = [c for c in scenes.columns if c not in ("width", "height")]
    placed = _windowed(scenes, others, tile, stride, strategy)
    placed = placed.withColumn("tile_id", radar_tile_id(F.col("scene_id"), F.col("row_idx"), F.col("col_idx")))
    placed = absolute_window(placed, F.col("crop_col_off"), F.col("crop_row_off"))
    placed = placed.withColumn("tile_gcps", tile_gcps(F.col("local_gcps"), F.col("col_off"), F.col("row_off")))
    placed = placed.withColumn("fit", local_affine(F.col("tile_gcps"), "tile_col", "tile_row"))
    return placed.withColumns({"modality": F.lit("sar"), "bounds_wgs84": affine_bounds(F.col("fit.coefficients"), tile)})


def _windowed(scenes: DataFrame, others: list[str], tile: int, stride: int | None, strategy: str) -> DataFrame:
    y = scenes.select(*others, "width", F.posexplode(axis_offsets(F.col("height"), tile, stride, strategy)).alias("row_idx", "y"))
    x = y.select(*others, "row_idx", "y", F.posexplode(axis_offsets(F.col("width"), tile, stride, strategy)).alias("col_idx", "x"))
    return x.select(*others, "row_idx", "col_idx", F.col("y.off").alias("row_off"), F.col("x.off").alias("col_off"), F.col("x.len").alias("width"), F.col("y.len").alias("height"))


def manifests(tiles: DataFrame, size: str | None = None) -> DataFrame:
    """One row per scene: total_tiles, grid_rows, grid_cols, total_bytes (of a column, else 0) and the tiles in order."""
    entry = F.struct("row_idx", "col_idx", "tile_id", "col_off", "row_off", "width", "height")
    amount = F.sum(F.col(size)) if size else F.lit(0).cast("long")
    return tiles.groupBy("scene_id").agg(
        F.count("*").alias("total_tiles"), (F.max("row_idx") + 1).alias("grid_rows"), (F.max("col_idx") + 1).alias("grid_cols"),
        amount.alias("total_bytes"), F.sort_array(F.collect_list(entry)).alias("tiles"),
    )


def tiling_summary(tiles: DataFrame, size: str) -> DataFrame:
    """Tiles and bytes by sensor and scene, by sensor, and in all (null keys)."""
    return tiles.rollup("modality", "scene_id").agg(F.count("*").alias("total_tiles"), F.sum(size).alias("total_bytes"))
