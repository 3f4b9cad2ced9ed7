"""Change detection from pairs to statuses: checks in a fixed order, magnitudes, masks, statistics.

Tiles stay rasters: a pair and the arrays of its two tiles meet in one group, where one kernel makes
magnitudes, statistics, thresholds and confirmed pixels (``compare_rasters``). Headers (tile_id, band,
shape, crs, affine (a, b, c, d, e, f), nodata) decide before that which pairs are compared at all, so that
no pixel of the others is moved. Pixel tables (tile_id, band, r, c, dn) are taken too: ``detect_changes``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraquarry.operators import kernels, suppression

#: What a pair's result can be, in the order in which it is decided.
STATUSES = (
    "unsupported_sar_unaligned", "unsupported_modality", "unaligned_optical_grid", "missing_raster_file", "dimension_mismatch", "crs_mismatch",
    "transform_mismatch", "resolution_mismatch", "bounds_mismatch", "no_valid_pixels", "insufficient_valid_pixels", "success",
)
#: The class layer's band, and how far it may be off.
CLASS_BAND, CLASS_OFFSET, CLASS_OVERLAP = "SCL", 1.05, 0.90
SIDE = 256
METHOD = "spectral_euclidean"


@dataclass(frozen=True)
class ChangeConfig:
    """What is compared and what counts as valid; wrong values are errors."""

    bands: tuple[str, ...] = ("B02", "B03", "B04", "B08")
    scale: float = 10000.0
    mask_nodata: bool = True
    mask_clouds: bool = True
    min_valid_ratio: float = 0.10
    #: Rows and columns of a tile; its class layer has half of them.
    side: int = SIDE

    def __post_init__(self) -> None:
        if not self.bands or not self.scale > 0 or not 0 <= self.min_valid_ratio <= 1 or self.side < 2 or self.side % 2:
            raise ValueError("bands must be given, scale be positive, min_valid_ratio be 0 to 1, and side be even")


def _resolution(affine: Column) -> Column:
    return F.array(F.abs(affine[0]), F.abs(affine[4]))


def _bounds(affine: Column, shape: Column) -> Column:
    return F.array(affine[2], affine[5] + shape[0] * affine[4], affine[2] + shape[1] * affine[0], affine[5])


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _header(head: Column) -> Column:
    """A header (shape, crs, affine) with what follows from it."""
    affine = head["affine"]
    return F.struct(head["shape"].alias("shape"), head["crs"].alias("crs"), affine.alias("affine"), _resolution(affine).alias("resolution"), _bounds(affine, head["shape"]).alias("bounds"), head.isNotNull().alias("there"))


def header_fault(ref: Column, comp: Column, side: int = SIDE) -> Column:
    """The first way in which two bands' headers (structs) differ, or null."""

    def first(p: Column) -> Column:
        differ = lambda c: ~p["r"][c].eqNullSafe(p["c"][c])
        found = F.when(differ("shape") | ~p["r"]["shape"].eqNullSafe(F.array(F.lit(side), F.lit(side))), "dimension_mismatch")
        for c, name in (("crs", "crs_mismatch"), ("affine", "transform_mismatch"), ("resolution", "resolution_mismatch"), ("bounds", "bounds_mismatch")):
            found = found.when(differ(c), name)
        return found

    return _let(F.struct(_header(ref).alias("r"), _header(comp).alias("c")), first)


def class_layer_fault(layer: Column, band: Column, side: int = SIDE) -> Column:
    """Why a class layer's header (a struct) does not lie on half the grid of a band's, or null; a missing one is no fault."""

    def overlap(p: Column) -> Column:
        a, b = p["l"]["bounds"], p["b"]["bounds"]
        sides = F.struct((F.least(a[2], b[2]) - F.greatest(a[0], b[0])).alias("w"), (F.least(a[3], b[3]) - F.greatest(a[1], b[1])).alias("h"))
        area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        shared = _let(sides, lambda s: F.when((s["w"] > 0) & (s["h"] > 0), s["w"] * s["h"]).otherwise(0.0))
        return _let(shared, lambda s: F.try_divide(s, area(a) + area(b) - s))

    def first(p: Column) -> Column:
        (la, lr, ls), (ba, br, bs) = ((p[k]["affine"], p[k]["resolution"], p[k]["shape"]) for k in "lb")
        near = lambda x, y, d: F.abs(x - y) <= d + 1e-5 * F.abs(y)
        rules = {
            "dimensions": (ls == F.array(F.lit(side // 2), F.lit(side // 2))) & (ls == F.transform(bs, lambda n: F.floor(n / 2).cast("int"))),
            "crs": p["l"]["crs"] == p["b"]["crs"],
            "resolution": near(lr[0], br[0] * 2, 1e-3) & near(lr[1], br[1] * 2, 1e-3),
            "pixel scale or rotation": near(la[0], ba[0] * 2, 1e-3) & near(la[4], ba[4] * 2, 1e-3) & near(la[1], F.lit(0.0), 1e-5) & near(la[3], F.lit(0.0), 1e-5),
            "origin": (F.abs(la[2] - ba[2]) <= lr[0] * CLASS_OFFSET) & (F.abs(la[5] - ba[5]) <= lr[1] * CLASS_OFFSET),
            "overlap": overlap(p) >= CLASS_OVERLAP,
        }
        found = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
        return F.when(p["l"]["there"] & p["b"]["there"], found)

    return _let(F.struct(_header(layer).alias("l"), _header(band).alias("b")), first)


def checked_pairs(pairs: DataFrame, headers: DataFrame, config: ChangeConfig = ChangeConfig()) -> DataFrame:
    """Pairs with ``fault`` (the first status short of pixels, or null), ``warnings`` and ``masked`` (whether class layers apply)."""
    bands = [*config.bands, CLASS_BAND]
    head = F.map_from_entries(F.collect_list(F.struct("band", F.struct("shape", "crs", "affine").alias("h"))))
    tiles = headers.where(F.col("band").isin(*bands)).groupBy("tile_id").agg(head.alias("heads"))
    joined = pairs
    for side in ("reference", "comparison"):
        joined = joined.join(tiles.select(F.col("tile_id").alias(f"{side}_tile_id"), F.col("heads").alias(f"{side}_heads")), f"{side}_tile_id", "left")
    at = lambda side, band: F.try_element_at(F.col(f"{side}_heads"), F.lit(band))
    missing = F.array_compact(F.array(*(F.when(at(s, b).isNull(), F.concat(F.col(f"{s}_tile_id"), F.lit(f"/{b}"))) for b in config.bands for s in ("reference", "comparison"))))
    by_header = F.coalesce(*(header_fault(at("reference", b), at("comparison", b), config.side) for b in config.bands))
    fault = (
        F.when(F.col("modality") == "sar", "unsupported_sar_unaligned")
        .when(F.col("modality") != "optical", "unsupported_modality")
        .when(~F.col("alignment.is_pixel_aligned"), "unaligned_optical_grid")
        .when(F.size(missing) > 0, "missing_raster_file")
        .otherwise(by_header)
    )
    staged = joined.withColumn("_fault", fault).withColumn("_missing", F.get(missing, F.lit(0)))
    fault = F.col("_fault")
    layers = at("reference", CLASS_BAND).isNotNull() & at("comparison", CLASS_BAND).isNotNull()
    off = F.coalesce(*(class_layer_fault(at(s, CLASS_BAND), at(s, config.bands[0]), config.side) for s in ("reference", "comparison")))
    staged = staged.withColumns({"_off": off, "_layers": layers & F.lit(config.mask_clouds)})
    layers, off = F.col("_layers"), F.col("_off")
    reason = (
        F.when(fault == "unsupported_sar_unaligned", "SAR rasters are not aligned: differencing needs terrain correction")
        .when(fault == "unsupported_modality", F.concat(F.lit("unsupported modality "), F.col("modality")))
        .when(fault == "unaligned_optical_grid", F.concat(F.lit("not pixel aligned: "), F.col("alignment.alignment_type")))
        .when(fault == "missing_raster_file", F.concat(F.lit("missing: "), F.col("_missing")))
        .when(fault.isNotNull(), fault)
        .when(layers & off.isNotNull(), F.concat(F.lit("class layer not applied: "), off))
    )
    masked = fault.isNull() & layers & off.isNull()
    return staged.select(*pairs.columns, fault.alias("fault"), F.array_compact(F.array(reason)).alias("warnings"), masked.alias("masked"))


#: What the kernel adds to a checked pair: the count and statistics of its magnitudes.
SEEN = "n_valid long, mean double, median double, p95 double, p99 double, max double, std double"
_SEEN = [f.split()[0] for f in SEEN.split(", ")]


def _bundles(checked: DataFrame, rasters: DataFrame, config: ChangeConfig) -> DataFrame:
    """The rasters that each pair without a fault needs: pair_id, side, band, nodata, shape, and ``data`` or ``cells``."""
    tiles = F.inline(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"{s}_tile_id").alias("tile_id")) for i, s in enumerate(("reference", "comparison")))))
    needed = checked.where("fault IS NULL").select("pair_id", "masked", tiles).distinct()
    bands = rasters.where(F.col("band").isin(*config.bands, CLASS_BAND))
    return needed.join(bands, "tile_id").where(F.col("masked") | (F.col("band") != CLASS_BAND)).drop("masked", "tile_id")


def _matrix(row: dict[str, pa.Scalar], config: ChangeConfig) -> np.ndarray:
    """A raster of a bundle's row, NaN where it has no pixel."""
    side = config.side // 2 if row["band"].as_py() == CLASS_BAND else config.side
    if "data" in row:
        return row["data"].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(side, side)
    out, cells = np.full(side * side, np.nan), row["cells"].values
    place = cells.field("place").to_numpy(zero_copy_only=False)
    inside = (place >= 0) & (place < side * side)
    out[place[inside]] = cells.field("dn").to_numpy(zero_copy_only=False)[inside]
    return out.reshape(side, side)


def _seen(tiles: pa.Table, masked: bool, config: ChangeConfig) -> np.ndarray:
    """A pair's magnitudes."""
    rows = {(t["side"].as_py(), t["band"].as_py()): t for t in ({n: tiles.column(n)[i] for n in tiles.column_names} for i in range(tiles.num_rows))}
    sides = [[_matrix(rows[s, b], config) for b in config.bands] if all((s, b) in rows for b in config.bands) else [np.full((config.side, config.side), np.nan)] * len(config.bands) for s in (0, 1)]
    nodata = [tuple(rows[s, b]["nodata"].as_py() if (s, b) in rows else None for s in (0, 1)) for b in config.bands]
    hidden = None
    if masked:
        layers = [kernels.hidden_by(_matrix(rows[s, CLASS_BAND], config)) for s in (0, 1) if (s, CLASS_BAND) in rows]
        hidden = np.logical_or.reduce(layers) if layers else None
    return kernels.magnitude(*sides, nodata, config.scale, hidden, config.mask_nodata)


def compared(checked: DataFrame, rasters: DataFrame, config: ChangeConfig = ChangeConfig(), limits: suppression.SuppressionConfig | None = None) -> DataFrame:
    """Checked pairs with ``seen`` (SEEN), ``magnitude`` (its raster, row by row, NaN where invalid) and, with ``limits``, ``found`` (suppression.FOUND); null for pairs with a fault.

    A pair and the rasters of its two tiles meet in one group (ten rasters of bounded size), and one
    kernel makes everything of them. ``rasters``: tile_id, band, nodata, and either ``data``
    (row by row) or ``cells`` (place, dn).
    """
    bundles = _bundles(checked, rasters, config).withColumnRenamed("pair_id", "_pair")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seen = found = raster = None
        if right.num_rows:
            values = _seen(right, left.column("masked")[0].as_py(), config).ravel()
            valid = values[np.isfinite(values)]
            numbers = kernels.summary(valid) if len(valid) else (None,) * (len(_SEEN) - 1)
            seen = dict(zip(_SEEN, (len(valid), *numbers), strict=True))
            raster = values.astype(np.float32)
            if limits is not None and len(valid) and len(valid) / config.side**2 >= config.min_valid_ratio:
                at = np.flatnonzero(np.isfinite(values))
                found = suppression.found_in(at, values[at], config.side, limits).as_py()
        count = left.num_rows
        kind = pa.struct([(n, pa.int64() if n == "n_valid" else pa.float64()) for n in _SEEN])
        columns = [*left.columns, pa.array([seen] * count, kind), pa.array([raster] * count, pa.list_(pa.float32()))]
        names = [*left.column_names, "seen", "magnitude"]
        if limits is not None:
            columns.append(pa.array([found] * count, suppression._FOUND))
            names.append("found")
        return pa.Table.from_arrays(columns, names=names)

    added = f"seen struct<{SEEN.replace(', ', ',').replace(' ', ': ').replace('long', 'bigint')}>, magnitude array<float>" + f", found {suppression.FOUND}" * (limits is not None)
    schema = StructType([*checked.schema.fields, *StructType.fromDDL(added).fields])
    return checked.groupBy("pair_id").cogroup(bundles.groupBy("_pair")).applyInArrow(run, schema)


def outcomes(found: DataFrame, columns: list[str], config: ChangeConfig = ChangeConfig()) -> DataFrame:
    """Of ``compared``: the pairs' columns, status, method, summary, warnings, masked, and what else it has (``magnitude``, ``found``).

    ``summary`` (null unless success) has mean, median, p95, p99, max, std, valid_pixel_ratio,
    valid_pixels, total_pixels.
    """
    total = config.side**2
    seen = F.col("seen")
    n = F.coalesce(seen["n_valid"], F.lit(0).cast("long"))
    ratio = n / float(total)
    status = F.coalesce("fault", F.when(n == 0, "no_valid_pixels").when(ratio < config.min_valid_ratio, "insufficient_valid_pixels").otherwise("success"))
    numbers = F.struct(*(seen[c].alias(c) for c in _SEEN[1:]), F.round(ratio, 6).alias("valid_pixel_ratio"), n.alias("valid_pixels"), F.lit(total).cast("long").alias("total_pixels"))
    short = F.when(status == "no_valid_pixels", "no valid pixel").when(status == "insufficient_valid_pixels", F.format_string("valid pixel ratio %.4f is below the minimum", ratio))
    method = F.when(F.col("fault").isin(*STATUSES[:3]), "unsupported").otherwise(METHOD)
    rest = [c for c in ("magnitude", "found") if c in found.columns]
    return found.select(*columns, status.alias("status"), method.alias("method"), F.when(status == "success", numbers).alias("summary"), F.concat("warnings", F.array_compact(F.array(short))).alias("warnings"), "masked", *rest)


def detect_changes(pairs: DataFrame, headers: DataFrame, pixels: DataFrame, config: ChangeConfig = ChangeConfig()) -> tuple[DataFrame, DataFrame]:
    """Results (see ``outcomes``) and magnitudes (pair_id, r, c, magnitude) of pixel tables: these are made rasters first.

    Magnitudes are there also where too few pixels are valid. Whoever has rasters takes
    ``compare_rasters``, which makes pixels of none.
    """
    width = F.when(F.col("band") == CLASS_BAND, config.side // 2).otherwise(config.side)
    inside = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < width) & (F.col("c") < width)
    cell = F.struct((F.col("r") * width + F.col("c")).cast("long").alias("place"), F.col("dn").cast("double").alias("dn"))
    cells = pixels.where(inside & F.col("band").isin(*config.bands, CLASS_BAND)).groupBy("tile_id", "band").agg(F.collect_list(cell).alias("cells"))
    rasters = headers.select("tile_id", "band", F.col("nodata").cast("double").alias("nodata")).join(cells, ["tile_id", "band"])
    found = outcomes(compared(checked_pairs(pairs, headers, config), rasters, config), pairs.columns, config)
    return found.drop("magnitude"), magnitude_pixels(found, config.side)


def magnitude_pixels(found: DataFrame, side: int = SIDE) -> DataFrame:
    """(pair_id, r, c, magnitude) of the valid pixels of ``compared``'s rasters."""
    flat = found.select("pair_id", F.posexplode("magnitude").alias("at", "magnitude")).where(~F.isnan("magnitude"))
    return flat.select("pair_id", F.expr(f"at div {side}").cast("long").alias("r"), (F.col("at") % side).cast("long").alias("c"), F.col("magnitude").cast("double").alias("magnitude"))


def compare_rasters(pairs: DataFrame, rasters: DataFrame, config: ChangeConfig = ChangeConfig(), limits: suppression.SuppressionConfig = suppression.SuppressionConfig()) -> DataFrame:
    """Change and suppression of every pair, from rasters (tile_id, band, height, width, crs, affine, nodata, data) in one kernel.

    The columns of ``outcomes`` (the change result, with its ``magnitude`` raster), and ``suppressed``:
    a struct of what ``suppression.judged`` makes of it, and ``pixels`` (the candidates).
    """
    headers = rasters.select("tile_id", "band", F.array("height", "width").alias("shape"), "crs", "affine", "nodata")
    found = compared(checked_pairs(pairs, headers, config), rasters.select("tile_id", "band", "nodata", "data"), config, limits)
    out = outcomes(found, pairs.columns, config)
    kept = [c for c in out.columns if c != "found"]
    verdict = suppression.judged(out.withColumn("_status", F.col("status")).withColumn("_warnings", F.col("warnings")).withColumn("_method", F.col("method")), F.col("found"))
    fields = [c for c in verdict.columns if c not in (*kept, "found", "_status", "_warnings", "_method")]
    given = {"_status": "status", "_warnings": "warnings", "_method": "method"}
    back = {v: k for k, v in given.items()}
    return verdict.select(*(F.col(back.get(c, c)).alias(c) for c in kept), F.struct("status", "method", "warnings", *fields, F.col("found.pixels").alias("pixels")).alias("suppressed"))


def from_arrays(tiles: DataFrame) -> DataFrame:
    """Pixels (tile_id, band, r, c, dn) of rasters held as arrays: tile_id, band, shape, data (row by row)."""
    flat = tiles.select("tile_id", "band", F.col("shape")[1].alias("_width"), F.posexplode("data").alias("_at", "dn"))
    return flat.select("tile_id", "band", F.expr("_at div _width").cast("long").alias("r"), (F.col("_at") % F.col("_width")).cast("long").alias("c"), "dn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables of the same columns."""
    return reduce(DataFrame.unionByName, frames)
