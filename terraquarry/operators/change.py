"""Spectral change and false-alarm suppression over pixel tables (pair_id, r, c, ...)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terraquarry.functions.scalars import is_finite
from terraquarry.operators import graph, kernels, selection
from terraquarry.operators.kernels import LEAST_CONFIDENCE, MAD_SCALE, MARGIN_WEIGHT, NEIGHBOR_WEIGHT, UNUSABLE_CLASSES
from terraquarry.storage import release, stored

PIXEL = ["pair_id", "r", "c"]


def usable(x: Column, nodata: float = 0.0) -> Column:
    return is_finite(x) & (x != nodata) & (x > 0)


def change_magnitude(reference: DataFrame, comparison: DataFrame, bands: list[str], scale: float = 10000.0) -> DataFrame:
    """The Euclidean distance of the bands' reflectances at each pixel that both have usable: (pair_id, r, c, magnitude)."""
    for band in bands:
        reference, comparison = reference.where(usable(F.col(band))), comparison.where(usable(F.col(band)))
    a = reference.select(*PIXEL, *(F.col(b).alias(f"a_{b}") for b in bands))
    b = comparison.select(*PIXEL, *(F.col(x).alias(f"b_{x}") for x in bands))
    squares = [F.pow((F.col(f"b_{x}") - F.col(f"a_{x}")) / scale, 2) for x in bands]
    return a.join(b, PIXEL).select(*PIXEL, F.sqrt(reduce(Column.__add__, squares)).alias("magnitude"))


def mask_classes(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pixels whose class, on a grid of half the resolution (pair_id, r2, c2, class), leaves the ground visible."""
    keyed = pixels.withColumn("r2", F.expr("r div 2")).withColumn("c2", F.expr("c div 2"))
    clear = classes.where(~F.col("class").isin(*UNUSABLE_CLASSES)).select("pair_id", "r2", "c2")
    return keyed.join(clear, ["pair_id", "r2", "c2"], "left_semi").drop("r2", "c2")


def thresholds(pixels: DataFrame, k: float = 3.0, offset: float = 0.0, by: str = "pair_id", limit: int = selection.LIMIT) -> DataFrame:
    """The median, its absolute deviation and the threshold of each raster, exact, whatever its size (``selection``)."""
    valid = pixels.where(is_finite(F.col("magnitude")))
    large = selection.any_large(valid, [by], limit)
    middle = selection.median(valid, [by], F.col("magnitude"), "median", limit, large)
    off = valid.join(middle, by).select(by, F.abs(F.col("magnitude") - F.col("median")).alias("off"))
    spread = middle.join(selection.median(off, [by], F.col("off"), "mad", limit, large), by)
    return spread.withColumn("threshold", F.col("median") + F.greatest(k * MAD_SCALE * F.col("mad"), F.lit(offset)))


def candidates(pixels: DataFrame, k: float = 3.0, offset: float = 0.0, limits: DataFrame | None = None) -> DataFrame:
    """Pixels over their raster's threshold (of ``limits``, if given), strictly."""
    limits = (thresholds(pixels, k, offset) if limits is None else limits).select("pair_id", "threshold")
    return pixels.join(limits, "pair_id").where(is_finite(F.col("magnitude")) & (F.col("magnitude") > F.col("threshold")))


#: Side of the blocks that a raster of any size is dealt into.
BLOCK = 512


def _in_blocks(pixels: DataFrame, block: int, min_neighbors: int | None) -> DataFrame:
    """``pixels`` with neighbors, and with ``min_neighbors`` also label and n: one group a block, in one shuffle.

    A pixel at a block's border is lent to the blocks beside it, so that each block has a halo of
    one pixel. ``label`` names the component within the block, of pixels with so many neighbours
    (null for others), by its least row, then column, as a struct; n is its size there.
    """
    at = lambda c, d: F.floor((F.col(c) + d) / block).cast("long")
    border = F.lit(False)
    for c in ("r", "c"):
        border = border | F.pmod(F.col(c), F.lit(block)).isin(0, block - 1)
    around = F.array_distinct(F.array(*(F.struct(at("r", i).alias("br"), at("c", j).alias("bc")) for i in (0, -1, 1) for j in (0, -1, 1))))
    own = F.struct(at("r", 0).alias("br"), at("c", 0).alias("bc"))
    dealt = pixels.withColumn("_at", F.explode(F.when(border, around).otherwise(F.array(own))))
    dealt = dealt.withColumns({"_br": F.col("_at.br"), "_bc": F.col("_at.bc")}).drop("_at")

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in "rc")
        top, left = table.column("_br")[0].as_py() * block, table.column("_bc")[0].as_py() * block
        wide = block + 2
        place = (r - top + 1) * wide + (c - left + 1)
        all_, first = np.unique(place, return_index=True)
        near = kernels.neighbor_counts(all_, wide)
        inside = (r[first] >= top) & (r[first] < top + block) & (c[first] >= left) & (c[first] < left + block)
        keep = first[inside]
        out = table.take(pa.array(keep)).drop_columns(["_br", "_bc"]).append_column("neighbors", pa.array(near[inside]))
        if min_neighbors is not None:
            good = near[inside] >= min_neighbors
            own = all_[inside]
            root = kernels.labels(own[good], wide)
            size = np.bincount(root, minlength=len(root))[root] if len(root) else root
            label, n = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            label[good], n[good] = own[good][root], size
            rows, columns = label // wide - 1 + top, label % wide - 1 + left
            named = pa.StructArray.from_arrays([pa.array(rows), pa.array(columns)], names=["r", "c"], mask=pa.array(~good))
            out = out.append_column("label", named).append_column("n", pa.array(n, mask=~good))
        return out

    fields = [StructField(f.name, f.dataType) for f in pixels.schema.fields] + StructType.fromDDL("neighbors long" + ", label struct<r: bigint, c: bigint>, n long" * (min_neighbors is not None)).fields
    return dealt.groupBy("pair_id", "_br", "_bc").applyInArrow(run, StructType(fields))


def neighbors8(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each masked pixel with the number of the eight around it that are masked as well; one that is given twice counts once."""
    return _in_blocks(mask, block, None)


def _components(local: DataFrame, block: int) -> DataFrame:
    """(pair_id, label, component, area) of the block components of ``_in_blocks``, joined up over the blocks' borders.

    Only pixels at borders meet their neighbours; what touches makes edges between block
    components, whose components name the whole. Areas are sums over block components, so no
    step has a component's pixels together.
    """
    at = {c: F.pmod(F.col(c), F.lit(block)) for c in ("r", "c")}
    edge = local.where("label IS NOT NULL").where(at["r"].isin(0, block - 1) | at["c"].isin(0, block - 1)).select(*PIXEL, F.struct("pair_id", "label").alias("node"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    lent = edge.select("*", F.explode(steps).alias("s")).select("pair_id", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), F.col("node").alias("a"))
    crossing = lent.join(edge.withColumnRenamed("node", "b"), PIXEL).where("a <> b").select("a", "b").distinct()
    parts = local.where("label IS NOT NULL").groupBy("pair_id", "label").agg(F.first("n").alias("n"))
    links = stored(crossing, "block-links")
    if links.isEmpty():
        release(links)
        return parts.select("pair_id", "label", F.col("label").alias("component"), F.col("n").alias("area"))
    whole = graph.connected_components(links)
    named = parts.withColumn("node", F.struct("pair_id", "label")).join(whole, "node", "left").select("pair_id", "label", F.coalesce("component.label", "label").alias("component"), "n")
    areas = named.groupBy("pair_id", "component").agg(F.sum("n").alias("area"))
    return named.join(areas, ["pair_id", "component"]).select("pair_id", "label", "component", "area")


def components8(mask: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(pair_id, r, c, component, area): 8-connected components, named by their least r * width + c.

    A raster of any size is dealt into blocks, which are labelled by themselves; block
    components that touch across borders are joined up, and pixels take the joint name and
    area. No task has a raster, nor a component, together. A pixel that is given twice counts
    once; a null pair_id is no raster. Jobs run here, for the joining up.
    """
    local = stored(_in_blocks(mask.where("pair_id IS NOT NULL").select(*PIXEL), block, 0), "block-labels")
    found = local.join(_components(local, block), ["pair_id", "label"])
    return found.select(*PIXEL, (F.col("component.r") * width + F.col("component.c")).alias("component"), "area")


def confidence() -> Column:
    """0.05 to 1 from magnitude, threshold and neighbors: half spectral margin, half density of candidates around."""
    total = F.col("magnitude") + F.col("threshold")
    margin = F.when(total > 0, (F.col("magnitude") - F.col("threshold")) / total).otherwise(0.0)
    return F.least(F.greatest(MARGIN_WEIGHT * margin + NEIGHBOR_WEIGHT * F.col("neighbors"), F.lit(LEAST_CONFIDENCE)), F.lit(1.0))


def supported(pixels: DataFrame, width: int, min_neighbors: int = 2, min_area: int = 4, block: int = BLOCK) -> DataFrame:
    """Candidates (pair_id, r, c, magnitude, threshold) with neighbors, component, area and confidence; the last three null where not confirmed.

    Confirmed are candidates of ``min_neighbors`` and more, in a component of them of ``min_area`` and
    more. For rasters of any size, as ``components8``; tiles go through ``detection.compare_rasters``.
    """
    local = stored(_in_blocks(pixels.where("pair_id IS NOT NULL"), block, min_neighbors), "block-labels")
    whole = _components(local, block).where(F.col("area") >= min_area)
    joined = local.join(whole, ["pair_id", "label"], "left").withColumn("confidence", F.when(F.col("area").isNotNull(), confidence()))
    return joined.withColumn("component", F.col("component.r") * width + F.col("component.c")).select(*pixels.columns, "neighbors", "component", "area", "confidence")


def suppress(pixels: DataFrame, width: int, k: float = 3.0, offset: float = 0.0, min_neighbors: int = 2, min_area: int = 4) -> DataFrame:
    """Confirmed pixels with their neighbours, component, area and confidence."""
    found = supported(candidates(pixels, k, offset), width, min_neighbors, min_area)
    return found.where("area IS NOT NULL").select(*PIXEL, "neighbors", "component", "area", "confidence")


def summary(pixels: DataFrame, total: int, min_ratio: float = 0.10) -> DataFrame:
    """Statistics of the finite magnitudes of each raster, their share of ``total`` pixels, and whether they suffice.

    n_valid, mean, median, p95, p99, max, std (of the population), valid_pixel_ratio, status. The
    statistics are null without a valid pixel. A group is one raster of bounded size: exact
    percentiles keep its distinct values.
    """
    x = F.when(is_finite(F.col("magnitude")), F.col("magnitude"))
    ratio = F.col("n_valid") / float(total)
    status = F.when(F.col("n_valid") == 0, "no_valid_pixels").when(ratio < min_ratio, "insufficient_valid_pixels").otherwise("success")
    stats = pixels.groupBy("pair_id").agg(
        F.count(x).alias("n_valid"), F.avg(x).alias("mean"), F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.max(x).alias("max"), F.stddev_pop(x).alias("std")
    )
    return stats.select("pair_id", "n_valid", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max", "std", ratio.alias("valid_pixel_ratio"), status.alias("status"))


def percentiles(pixels: DataFrame) -> DataFrame:
    """The 95th and 99th percentile of each raster's valid magnitudes, interpolated, exact."""
    valid = pixels.where(is_finite(F.col("magnitude")))
    return valid.groupBy("pair_id").agg(F.percentile("magnitude", 0.95).alias("p95"), F.percentile("magnitude", 0.99).alias("p99"))
