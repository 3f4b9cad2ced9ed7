"""False-alarm suppression from change results to confirmed pixels, counts and statuses.

A pair's magnitudes are one raster of bounded size: ``found_in`` judges it in one kernel, in the task
that has it. Nothing is scanned twice, and a pair's pixels are shuffled at most once, to form the raster.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraquarry.operators import kernels

#: The method's name, and that of results that are passed on.
METHOD, PASSED_ON = "adaptive_mad_suppression", "unsupported"


@dataclass(frozen=True)
class SuppressionConfig:
    """Limits of the suppression; wrong types are TypeErrors, wrong values ValueErrors."""

    sensitivity_k: float = 3.0
    min_threshold_offset: float = 0.0
    min_neighbors: int = 2
    min_region_area: int = 4
    min_valid_pixels: int = 100

    def __post_init__(self) -> None:
        for name in ("sensitivity_k", "min_threshold_offset"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float):
                raise TypeError(f"{name} must be a real number, not {type(value).__name__}")
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{name} must be finite and not negative")
        for name, low, high in (("min_neighbors", 0, 8), ("min_region_area", 1, math.inf), ("min_valid_pixels", 1, math.inf)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{name} must be an integer, not {type(value).__name__}")
            if not low <= value <= high:
                raise ValueError(f"{name} must be {low} or more" + f" and at most {high}" * (high < math.inf))


#: What ``found_in`` adds: numbers of a judged raster, and its candidate pixels.
NUMBERS = "n_rows long, n_valid long, threshold double, median double, mad double, candidate_pixels long, confirmed_pixels long, mean_confidence double, max_confidence double"
CANDIDATE = "struct<r: bigint, c: bigint, magnitude: double, threshold: double, neighbors: bigint, component: bigint, area: bigint, confidence: double>"
_CANDIDATE = pa.struct([(n, pa.float64() if n in ("magnitude", "threshold", "confidence") else pa.int64()) for n in ("r", "c", "magnitude", "threshold", "neighbors", "component", "area", "confidence")])
FOUND = f"struct<{', '.join(f.replace(' ', ': ').replace('long', 'bigint') for f in NUMBERS.split(', '))}, pixels: array<{CANDIDATE}>>"
_FOUND = pa.struct([(n, pa.int64() if k == "long" else pa.float64()) for n, k in (f.split() for f in NUMBERS.split(", "))] + [("pixels", pa.list_(_CANDIDATE))])


def found_in(place: np.ndarray, values: np.ndarray, width: int, config: SuppressionConfig) -> pa.StructScalar:
    """The numbers and candidates of one raster: its pixels' places (row * width + column, distinct) and magnitudes, finite or not.

    Magnitudes and thresholds are compared as 32-bit floats. With fewer finite magnitudes than
    ``min_valid_pixels`` there are the counts alone.
    """
    finite = np.isfinite(values)
    numbers = {"n_rows": len(values), "n_valid": int(finite.sum()), "candidate_pixels": 0, "confirmed_pixels": 0}
    if numbers["n_valid"] < config.min_valid_pixels:
        return pa.scalar(numbers | {"pixels": []}, _FOUND)
    order = np.argsort(place[finite], kind="stable")
    place, values = place[finite][order], values[finite][order].astype(np.float32).astype(np.float64)
    median, mad, threshold = kernels.limits(values, config.sensitivity_k, config.min_threshold_offset)
    threshold_used = float(np.float32(threshold))
    pixels = kernels.candidates(place, values, width, threshold_used, config.min_neighbors, config.min_region_area)
    good = pixels["component"] >= 0
    numbers |= {"threshold": threshold, "median": median, "mad": mad, "candidate_pixels": len(good), "confirmed_pixels": int(good.sum())}
    if good.any():
        sure = pixels["confidence"][good]
        numbers |= {"mean_confidence": float(sure.mean()), "max_confidence": float(sure.max())}
    unsure = ~good
    own = pa.StructArray.from_arrays(
        [
            pa.array(pixels["place"] // width), pa.array(pixels["place"] % width), pa.array(pixels["magnitude"]), pa.array(np.full(len(good), threshold_used)), pa.array(pixels["neighbors"]),
            pa.array(pixels["component"], mask=unsure), pa.array(pixels["area"], mask=unsure), pa.array(pixels["confidence"], mask=unsure),
        ],
        fields=list(_CANDIDATE),
    )
    return pa.scalar(numbers | {"pixels": own}, _FOUND)


def judged(results: DataFrame, found: Column) -> DataFrame:
    """``results`` with the outcome in place of status, warnings and method; ``found`` (FOUND) is null where a pair has no magnitudes."""
    passed = (F.col("modality") == "sar") | (F.col("status") != "success")
    number = lambda c: F.coalesce(F.when(~passed, found[c]), F.lit(0).cast("long"))
    n = number("n_valid")
    measure = lambda c: F.when(~passed, F.round(found[c], 6))
    none = F.coalesce(found["n_rows"], F.lit(0)) == 0
    # the minimum that the kernel held: it gives a threshold wherever it judged
    few = found["threshold"].isNull()
    status = (
        F.when(F.col("modality") == "sar", "unsupported_sar_unaligned").when(F.col("status") != "success", F.col("status"))
        .when(none, "missing_change_data").when(n == 0, "no_valid_pixels").when(few, "insufficient_valid_pixels").otherwise("success")
    )
    said = (
        F.when(F.col("modality") == "sar", "SAR results are passed on").when(F.col("status") != "success", F.lit(None))
        .when(none, "no change magnitudes").when(n == 0, "no valid pixel").when(few, F.format_string("%d valid pixels are below the minimum", n))
    )
    kept = [c for c in results.columns if c not in ("status", "warnings", "method")]
    ratio = F.when(n > 0, number("confirmed_pixels") / n).otherwise(0.0)
    return results.select(
        *kept, status.alias("status"), F.when(passed, PASSED_ON).otherwise(METHOD).alias("method"), F.concat("warnings", F.array_compact(F.array(said))).alias("warnings"),
        measure("threshold").alias("threshold_used"), measure("median").alias("noise_median"), measure("mad").alias("noise_mad"),
        number("candidate_pixels").alias("candidate_pixels"), (number("candidate_pixels") - number("confirmed_pixels")).alias("suppressed_pixels"), number("confirmed_pixels").alias("confirmed_pixels"),
        F.round(ratio, 6).alias("confirmed_change_ratio"), measure("mean_confidence").alias("mean_confidence"), measure("max_confidence").alias("max_confidence"), n.alias("valid_pixels"),
    )


def suppress_changes(results: DataFrame, magnitudes: DataFrame, config: SuppressionConfig = SuppressionConfig(), width: int = 256) -> tuple[DataFrame, DataFrame]:
    """Suppressed results and candidate pixels.

    ``results`` has pair_id, modality, status, warnings; ``magnitudes`` pair_id, r, c, magnitude.
    Results: their columns with status, warnings and method replaced, and threshold_used,
    noise_median, noise_mad, candidate_pixels, suppressed_pixels, confirmed_pixels,
    confirmed_change_ratio, mean_confidence, max_confidence, valid_pixels (numbers of pairs that
    weren't judged are 0, measures null). A radar result, or one that isn't a success, is passed
    on; a success without magnitudes is missing_change_data, without finite ones no_valid_pixels,
    with too few insufficient_valid_pixels. Candidates: pair_id and the fields of CANDIDATE; those with
    an area are confirmed. Of a pixel that is given twice, one counts.
    """
    open_ = results.where((F.col("modality") != "sar") & (F.col("status") == "success")).select("pair_id").distinct()
    cell = F.struct((F.col("r") * width + F.col("c")).cast("long").alias("place"), F.col("magnitude").cast("double").alias("value"))
    packed = magnitudes.join(open_, "pair_id", "left_semi").groupBy("pair_id").agg(F.collect_list(cell).alias("cells"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                cells = batch.column("cells")[at].values
                place = cells.field("place").to_numpy(zero_copy_only=False)
                values = cells.field("value").to_numpy(zero_copy_only=False).astype(np.float64)
                _, first = np.unique(place, return_index=True)
                found.append(found_in(place[first], values[first], width, config))
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array([f.as_py() for f in found], _FOUND)], names=["pair_id", "found"])

    kind = magnitudes.schema["pair_id"].dataType.simpleString()
    found = packed.mapInArrow(run, f"pair_id {kind}, found {FOUND}")
    out = judged(results.join(found.select("pair_id", F.col("found").dropFields("pixels").alias("_found")), "pair_id", "left"), F.col("_found")).drop("_found")
    return out, found.select("pair_id", F.inline("found.pixels"))


def suppress_rasters(changes: DataFrame, config: SuppressionConfig = SuppressionConfig(), width: int = 256, files: DataFrame | None = None) -> DataFrame:
    """Suppressed results with ``pixels`` (candidates) of change results that have their magnitudes as rasters.

    ``changes`` has pair_id, modality, status, warnings and ``magnitude`` (row by row, NaN where
    invalid, or null). Where it is null, the raster of the pair in ``files`` (pair_id, magnitude;
    see ``workflows.stored_magnitudes``) takes its place, if these are given; a success without
    either is missing_raster_file then, and else missing_change_data. No raster is shuffled
    but for the join with the files.
    """
    rows = changes
    if files is not None:
        on_file = files.select(F.col("pair_id").cast(changes.schema["pair_id"].dataType).alias("pair_id"), F.col("magnitude").alias("_on_file"))
        rows = changes.join(on_file, "pair_id", "left").withColumn("magnitude", F.coalesce("magnitude", "_on_file")).drop("_on_file")
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for modality, status, raster in zip(*(batch.column(names.index(c)) for c in ("modality", "status", "magnitude")), strict=True):
                if modality.as_py() == "sar" or status.as_py() != "success" or not raster.is_valid:
                    found.append(None)
                    continue
                values = raster.values.to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.flatnonzero(~np.isnan(values))
                found.append(found_in(at, values[at], width, config).as_py() if len(at) else {"n_rows": len(values), "n_valid": 0, "candidate_pixels": 0, "confirmed_pixels": 0, "pixels": []})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], names=[*names, "found"])

    made = rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(f"found {FOUND}").fields]))
    out = judged(made, F.col("found")).withColumn("pixels", F.col("found.pixels")).drop("magnitude", "found")
    if files is not None:
        out = out.withColumn("status", F.when(F.col("status") == "missing_change_data", "missing_raster_file").otherwise(F.col("status")))
    return out
