"""Closed-form cases of the operators: tiling, pairing, change, suppression, index, evaluation, files."""

import datetime
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terraquarry.functions import scalars
from terraquarry.operators import change, detection, embedding, evaluation, index, pairing, search, stats, suppression, tiling
from terraquarry.plans import workflows
from terraquarry.sources import geotiff, scenes, tables

UTM = "EPSG:32643"
TILE = "tile_id string, scene_id string, modality string, acquisition_datetime_utc string, row_idx int, col_idx int, bounds_wgs84 array<double>, bounds_projected array<double>, crs string, tile_directory string"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---------------------------------------------------------------- tiling


def offsets(dim, tile, stride, strategy):
    """The rule, step by step: whole tiles while they fit, then what the strategy makes of the rest."""
    if dim <= tile:
        return [(0, tile if strategy == "pad" else dim)]
    out, at = [], 0
    while at + tile <= dim:
        out.append((at, tile))
        at += stride
    if at < dim:
        rest = {"shift": (dim - tile, tile), "truncate": (at, dim - at), "pad": (at, tile)}[strategy]
        if rest != out[-1]:
            out.append(rest)
    return out


@pytest.mark.parametrize("strategy", tiling.STRATEGIES)
@pytest.mark.parametrize(("tile", "stride"), [(256, 256), (256, 128), (100, 700), (100, 33), (1, 1)])
def test_axis_offsets(spark, tile, stride, strategy):
    dims = [1, 99, 100, 101, 255, 256, 257, 512, 600, 700, 1599, 1679, 1976, 1999]
    frame = spark.createDataFrame([(d,) for d in dims], "d int").select("d", tiling.axis_offsets(F.col("d"), tile, stride, strategy).alias("o"))
    assert {r.d: [tuple(x) for x in r.o] for r in frame.collect()} == {d: offsets(d, tile, stride, strategy) for d in dims}


def test_sizes_that_are_not_positive_are_errors(spark):
    with pytest.raises(ValueError):
        tiling.axis_offsets(F.lit(5), 0)
    with pytest.raises(ValueError):
        tiling.axis_offsets(F.lit(5), 2, strategy="mirror")
    with pytest.raises(PySparkException):
        one(spark, tiling.axis_offsets(F.lit(0), 2))


def test_bounds_in_degrees(spark):
    """A point on a zone's central meridian and the equator, and one that forward formulas give."""
    center = one(spark, tiling.utm_to_degrees(F.lit(500000.0), F.lit(0.0), F.lit(43), F.lit(False)).alias("p")).p
    assert (center.lon, center.lat) == (75.0, 0.0)
    south = one(spark, tiling.utm_to_degrees(F.lit(500000.0), F.lit(1e7), F.lit(1), F.lit(True)).alias("p")).p
    assert south.lon == -177.0 and abs(south.lat) < 1e-12
    # a degree of latitude at the equator is 110574.4 m on the ellipsoid, times the scale on the meridian
    north = one(spark, tiling.utm_to_degrees(F.lit(500000.0), F.lit(110574.39 * 0.9996), F.lit(43), F.lit(False)).alias("p")).p
    assert abs(north.lat - 1) < 1e-6
    box = one(spark, tiling.wgs84_bounds(F.lit(UTM), F.array(*map(F.lit, (300000.0, 2090000.0, 302560.0, 2092560.0)))).alias("b")).b
    assert box[0] < box[2] and box[1] < box[3] and 73 < box[0] < 73.2 and 18.8 < box[1] < 19
    assert one(spark, tiling.wgs84_bounds(F.lit("EPSG:3857"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).alias("b")).b is None


def test_affine_fit_with_residuals(spark):
    points = [(str(i), 100.0 * (i % 3), 100.0 * (i // 3), 73 + 0.01 * (i % 3), 19 - 0.009 * (i // 3) + (1e-5 if i == 4 else 0)) for i in range(9)]
    frame = spark.createDataFrame([(points,), (points[:2],), ([],)], "g array<struct<id string,local_col double,local_row double,lon double,lat double>>")
    found = [r.f for r in frame.select(tiling.local_affine(F.col("g")).alias("f")).collect()]
    a = np.column_stack([[p[1] for p in points], [p[2] for p in points], np.ones(9)])
    fits = [np.linalg.lstsq(a, np.array([p[k] for p in points]), rcond=None)[0] for k in (3, 4)]
    assert np.allclose(found[0].coefficients, np.concatenate(fits), atol=1e-9)
    error = [(a @ fits[k] - np.array([p[3 + k] for p in points])) * m for k, m in ((0, 105307.72), (1, 110691.77))]
    assert found[0].rmse_metres == round(float(np.sqrt(np.mean(error[0] ** 2 + error[1] ** 2))), 2)
    assert [f.coefficients for f in found[1:]] == [[0.0] * 6] * 2 and [f.gcp_count for f in found] == [9, 2, 0]


def test_display_scales(spark):
    r = one(spark, *(tiling.optical_scale(F.lit(float(x))).alias(f"o{x}") for x in (0, 3500, 9000, -5)), tiling.radar_levels(F.lit(-3.0), F.lit(10**3.2 - 1)).alias("l"))
    assert (r.o0, r["o3500"], r["o9000"], r["o-5"]) == (0, 255, 255, 0)
    assert r.l == [0.0, 1.0, 0.5]


# ---------------------------------------------------------------- scalars


def test_datetimes():
    day = datetime.datetime(2022, 1, 20, tzinfo=datetime.UTC)
    assert scalars.filter_datetime(None) is None
    assert scalars.filter_datetime("2022-01-20") == scalars.filter_datetime(datetime.date(2022, 1, 20)) == scalars.filter_datetime("20220120") == day
    assert scalars.filter_datetime("2022-01-20", True) == day + datetime.timedelta(days=1, microseconds=-1)
    assert scalars.filter_datetime(" 2022-01-20T02:00:00+02:00 ", True) == scalars.filter_datetime("2022-01-20T00:00:00z") == day
    for bad in ("", "  ", "yesterday"):
        with pytest.raises(ValueError):
            scalars.filter_datetime(bad)
    for bad in (True, 5):
        with pytest.raises(TypeError):
            scalars.filter_datetime(bad)


def test_strict_datetimes_and_sizes(spark):
    assert one(spark, scalars.strict_iso_datetime(F.lit("2022-01-20T10:00:00Z")).cast("string").alias("t")).t == "2022-01-20 10:00:00"
    for bad in ("", "x"):
        with pytest.raises(PySparkException):
            one(spark, scalars.strict_iso_datetime(F.lit(bad)))
    got = [one(spark, scalars.file_size_text(F.lit(n)).alias("s")).s for n in (0, 1023, 1024, 627256525, 3 * 1024**5)]
    assert got == ["0 B", "1023 B", "1.0 KB", "598.2 MB", "3072.0 TB"]
    assert one(spark, scalars.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), scalars.unit(F.array(F.lit(0.0))).alias("z")) == (pytest.approx([0.6, 0.8]), None)


# ---------------------------------------------------------------- pairing


def tile(name, scene, when, modality="optical", cell=(0, 0), bounds=(73.0, 19.0, 73.1, 19.1), projected=(0.0, 0.0, 1.0, 1.0), crs=UTM):
    return name, scene, modality, when, *cell, list(bounds) if bounds else None, list(projected), crs, f"tiles/{name}"


def chosen(spark, rows, name, **more):
    r = pairing.pair_for_tile(spark.createDataFrame(rows, TILE), name, **more).collect()
    return (r[0].reference_tile_id, r[0].comparison_tile_id) if r else None


def test_the_nearest_counterpart(spark):
    rows = [tile("q", "s1", "2023-01-01T00:00:00Z"), tile("far", "s2", "2022-01-01"), tile("near", "s3", "2023-06-01")]
    assert chosen(spark, rows, "q") == ("q", "near")
    assert chosen(spark, rows, "q", target_scene="s2") == ("far", "q")
    even = [tile("q", "s1", "2023-06-01"), tile("past", "s2", "2023-05-02"), tile("future", "s3", "2023-07-01")]
    assert chosen(spark, even, "q") == ("q", "future")
    same = [tile("q", "s1", "2023-01-01"), tile("z", "zulu", "2024-01-01"), tile("a", "alpha", "2024-01-01")]
    assert chosen(spark, same, "q") == ("q", "a")
    nine = [tile("q", "s1", "2023-01-01"), tile("p", "s2", "2023-01-10")]
    assert chosen(spark, nine, "q", min_days=15) is None and chosen(spark, nine, "q", max_days=5) is None
    assert chosen(spark, nine, "q", min_days=5, max_days=10) == ("q", "p")
    for bad in ({"min_days": 20, "max_days": 10}, {"min_days": -1}):
        with pytest.raises(ValueError):
            chosen(spark, nine, "q", **bad)
    for bad in ({"min_days": True}, {"max_days": "5"}, {"target_scene": 5}):
        with pytest.raises(TypeError):
            chosen(spark, nine, "q", **bad)
    with pytest.raises(KeyError):
        chosen(spark, nine, "none")
    with pytest.raises(KeyError):
        chosen(spark, nine, "q", target_scene="none")


def test_pairs_are_described(spark):
    rows = [tile("a", "s1", "2023-01-01"), tile("b", "s2", "2023-01-11"), tile("c", "s3", "2023-01-21", projected=(1.0, 0.0, 2.0, 1.0), bounds=(73.05, 19.0, 73.15, 19.1)), tile("r", "q1", "2023-01-01", "sar"), tile("t", "q2", "2023-01-02", "sar"), tile("n", "s4", "2023-01-05", cell=(0, 1))]
    found = {r.pair_id: r for r in pairing.all_tile_pairs(spark.createDataFrame(rows, TILE)).collect()}
    assert found.keys() == {"pair__a__b", "pair__a__c", "pair__b__c", "pair__r__t"}
    p = found["pair__a__b"]
    assert (p.temporal_delta_days, p.spatial.method, p.spatial.spatial_iou_wgs84, p.alignment.alignment_type, p.alignment.is_pixel_aligned) == (10.0, pairing.EXACT, 1.0, pairing.ALIGNED, True)
    p = found["pair__a__c"]
    assert (p.spatial.method, p.alignment.alignment_type) == (pairing.TOPOLOGICAL, pairing.UNALIGNED_METADATA) and abs(p.spatial.spatial_iou_wgs84 - 1 / 3) < 1e-6
    assert found["pair__r__t"].alignment.alignment_type == pairing.UNALIGNED_RADAR and found["pair__r__t"].alignment.crs is None


def test_pairs_of_two_scenes(spark):
    rows = [tile("a", "s1", "2023-01-01"), tile("b", "s2", "2023-02-01"), tile("r", "q", "2023-03-01", "sar"), tile("far", "s3", "2023-04-01", bounds=(10.0, 10.0, 11.0, 11.0)), tile("same", "s4", "2023-01-01T00:00:00+00:00"), tile("cell", "s5", "2023-05-01", cell=(3, 3))]
    tiles = spark.createDataFrame(rows, TILE)
    assert [r.pair_id for r in pairing.pairs_of_scenes(tiles, "s2", "s1").collect()] == ["pair__a__b"]
    assert pairing.pairs_of_scenes(tiles, "s1", "s3").count() == 0
    for other, reason in (("q", "modality"), ("s4", "identical"), ("s5", "grid"), ("s1", "itself")):
        with pytest.raises(ValueError, match=reason):
            pairing.pairs_of_scenes(tiles, "s1", other)
    with pytest.raises(KeyError):
        pairing.pairs_of_scenes(tiles, "s1", "none")


def test_headers_decide_where_there_are_some(spark):
    head = lambda **m: {"shape": [256, 256], "header_crs": UTM, "affine": [10.0, 0.0, 0.0, 0.0, -10.0, 0.0], "resolution": [10.0, 10.0], "header_bounds": [0.0, 0.0, 1.0, 1.0]} | m
    schema = TILE + ", shape array<int>, header_crs string, affine array<double>, resolution array<double>, header_bounds array<double>"
    changes = [({}, pairing.ALIGNED), ({"shape": [128, 128], "header_crs": "x"}, pairing.HEADER_MISMATCHES[0]), ({"header_crs": "x"}, pairing.HEADER_MISMATCHES[1]), ({"affine": [20.0, 0.0, 0.0, 0.0, -10.0, 0.0]}, pairing.HEADER_MISMATCHES[2]), ({"header_bounds": [0.0, 0.0, 1.0, 2.0]}, pairing.HEADER_MISMATCHES[4])]
    for more, want in changes:
        rows = [(*tile("a", "s1", "2023-01-01"), *head().values()), (*tile("b", "s2", "2023-02-01"), *head(**more).values())]
        assert pairing.all_tile_pairs(spark.createDataFrame(rows, schema)).first().alignment.alignment_type == want


def test_index_violations(spark):
    rows = [tile("ok", "s1", "2023-01-01"), tile("", "s2", "2023-01-01"), tile("m", "s3", "2023-01-01", "radio"), tile("t", "s4", "soon"), tile("i", "s5", "2023-01-01", bounds=(5.0, 0.0, 1.0, 1.0)), tile("d", "s6", "2023-01-01"), tile("d", "s7", "2023-01-01"), tile("g", "s8", "2023-01-01"), tile("h", "s8", "2023-01-01"), tile("n", "s9", "2023-01-01", bounds=None)]
    got = {(r.tile_id, r.scene_id): r.errors for r in pairing.index_violations(spark.createDataFrame(rows, TILE)).collect()}
    assert got == {("", "s2"): "tile_id", ("m", "s3"): "modality", ("t", "s4"): "acquisition_datetime_utc", ("i", "s5"): "inverted_bounds", ("d", "s6"): "duplicate_tile_id", ("d", "s7"): "duplicate_tile_id", ("g", "s8"): "duplicate_grid_index", ("h", "s8"): "duplicate_grid_index", ("n", "s9"): "bounds_wgs84,inverted_bounds"}


def test_one_hot_key_is_paired_as_brute_force_does(spark):
    draw = np.random.default_rng(4)
    times = draw.integers(0, 10**6, 300).tolist()
    rows = [(1, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "k int, scene_id int, acquired timestamp")
    for low, high in ((0.0, None), (0.5, None), (0.0, 0.05), (0.25, 3.0)):
        want = {}
        for i, t in enumerate(times):
            near = [(abs(u - t), u < t, j) for j, u in enumerate(times) if u != t and abs(u - t) >= low * 86400]
            if near and (high is None or min(near)[0] <= high * 86400):
                want[i] = min(near)[2]
        for ranges in (1, 5, 40):
            assert {r.scene_id: r.partner_id for r in pairing.nearest_in_time(frame, ["k"], low, high, ranges=ranges).collect()} == want
    want = {(i, j) for i, t in enumerate(times) for j, u in enumerate(times) if 0 < u - t <= 0.5 * 86400}
    assert {(r.reference_id, r.comparison_id) for r in pairing.all_pairs(frame, ["k"], max_days=0.5).collect()} == want


def test_a_hot_key_lies_in_all_ranges(spark):
    """One key with 400,000 instants, in ranges of about as many rows each; the neighbours are those of the sorted instants."""
    frame = spark.range(400_000).selectExpr("1 AS k", "id AS scene_id", "timestamp_micros(id * 1000 + id % 7) AS acquired")
    found = pairing.nearest_in_time(frame, ["k"], ranges=16)
    us = np.arange(400_000) * 1000 + np.arange(400_000) % 7
    ahead, behind = np.append(np.diff(us), 10**9), np.append(10**9, np.diff(us))
    want = np.where(ahead <= behind, np.arange(400_000) + 1, np.arange(400_000) - 1)
    got = found.toPandas().sort_values("scene_id")
    assert (got["partner_id"].to_numpy() == want).all()
    dealt = pairing._beside(frame.selectExpr("k", "unix_micros(acquired) AS v", "1 AS kind", "named_struct('us', unix_micros(acquired), 'scene', scene_id) AS point"), ["k"], 16)
    assert dealt.count() == 400_000
    sizes = pairing.stored(frame.repartitionByRange(16, "k", "acquired").withColumn("range", F.spark_partition_id()), "test").groupBy("range").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 3 * 400_000 / 16


# ---------------------------------------------------------------- change and suppression


def rasters(spark, tiles):
    """Headers and pixels of tiles: {tile: {band: (matrix, changes to the header)}}."""
    heads, arrays = [], []
    for name, bands in tiles.items():
        for band, (matrix, more) in bands.items():
            scale = 20.0 if band == "SCL" else 10.0
            head = {"shape": list(matrix.shape), "crs": UTM, "affine": [scale, 0.0, 0.0, 0.0, -scale, 0.0], "nodata": 0.0 if band != "SCL" else None} | more
            heads.append((name, band, *head.values()))
            arrays.append({"tile_id": name, "band": band, "shape": np.array(matrix.shape, np.int32), "data": matrix.ravel().astype(np.int32)})
    headers = spark.createDataFrame(heads, "tile_id string, band string, shape array<int>, crs string, affine array<double>, nodata double")
    return headers, detection.from_arrays(spark.createDataFrame(pa.Table.from_pylist(arrays)).repartition(4))


def flat(value, side=256):
    return np.full((side, side), value)


def optical(value=1000, **bands):
    return {b: (flat(value), {}) for b in ("B02", "B03", "B04", "B08")} | bands


def detected(spark, cases, config=detection.ChangeConfig()):
    """Results by case, and magnitudes, of {name: (reference bands, comparison bands, modality, projected bounds of the comparison)}."""
    rows, bands = [], {}
    for at, (name, (reference, comparison, modality, projected)) in enumerate(cases.items()):
        rows += [tile(f"{name}_a", f"{name}_1", "2023-01-01", modality, (at, 0)), tile(f"{name}_b", f"{name}_2", "2023-02-01", modality, (at, 0), projected=projected)]
        bands |= {f"{name}_a": reference, f"{name}_b": comparison}
    pairs = pairing.all_tile_pairs(spark.createDataFrame(rows, TILE))
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    results, values = detection.detect_changes(pairs, *rasters(spark, bands), config)
    return {r.reference_tile_id[:-2]: r for r in results.collect()}, values


HERE, CLEAR = (0.0, 0.0, 1.0, 1.0), (np.full((128, 128), 4), {})


def test_magnitudes_and_masks(spark):
    half, clouds, one_pixel = flat(1000), flat(4, 128), flat(4, 128)
    half[:128], clouds[:64, :64], one_pixel[0, 0] = 0, 8, 8
    off = {"crs": {"crs": "EPSG:1"}, "resolution": {"affine": [10.0, 0.0, 0.0, 0.0, -10.0, 0.0]}, "origin": {"affine": [20.0, 0.0, 25.0, 0.0, -20.0, 0.0]}, "rotation": {"affine": [20.0, 1.0, 0.0, 0.0, -20.0, 0.0]}}
    cases = {
        "same": (optical(1500), optical(1500)), "all": (optical(1000), optical(2000)), "one": (optical(), optical(B04=(flat(2000), {}))), "half": (optical(), optical(B04=(half, {}))),
        "clouds": (optical(SCL=CLEAR), optical(SCL=(clouds, {}))), "pixel": (optical(SCL=CLEAR), optical(SCL=(one_pixel, {}))),
        "near": (optical(SCL=(flat(4, 128), {"affine": [20.0, 0.0, 10.0, 0.0, -20.0, 0.0]})), optical(SCL=CLEAR)),
    } | {k: (optical(SCL=(flat(8, 128), more)), optical(SCL=(flat(8, 128), {}))) for k, more in off.items()}
    found, values = detected(spark, {k: (*v, "optical", HERE) for k, v in cases.items()})
    assert {r.status for r in found.values()} == {"success"}
    r = found["same"].summary
    assert (r.mean, r.max, r.std, r.valid_pixels) == (0.0, 0.0, 0.0, 65536)
    assert abs(found["all"].summary.mean - 0.2) < 1e-5 and abs(found["all"].summary.p99 - 0.2) < 1e-5 and abs(found["one"].summary.mean - 0.1) < 1e-5
    assert (found["half"].summary.valid_pixels, found["half"].summary.valid_pixel_ratio) == (32768, 0.5)
    assert found["clouds"].masked and found["clouds"].summary.valid_pixels == 49152 and found["near"].masked
    kept = {(x.r, x.c) for x in values.where("pair_id LIKE 'pair__pixel%'").collect()}
    assert {(i, j) for i in range(256) for j in range(256)} - kept == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for fault in off:
        assert not found[fault].masked and fault in found[fault].warnings[0] and found[fault].summary.valid_pixels == 65536


def test_statuses(spark):
    few = flat(0)
    few[:12] = 1000
    gone = optical()
    del gone["B04"]
    cases = {
        "no_valid_pixels": (optical(0), optical(), "optical", HERE), "insufficient_valid_pixels": (optical(), optical(B02=(few, {})), "optical", HERE),
        "unsupported_sar_unaligned": (optical(), optical(), "sar", HERE), "unaligned_optical_grid": (optical(), optical(), "optical", (9.0, 0.0, 1.0, 1.0)),
        "dimension_mismatch": (optical(B08=(flat(1, 128), {})), optical(B08=(flat(1, 128), {})), "optical", HERE), "crs_mismatch": (optical(), optical(B03=(flat(1000), {"crs": "EPSG:1"})), "optical", HERE),
        "transform_mismatch": (optical(), optical(B03=(flat(1000), {"affine": [10.0, 0.0, 5.0, 0.0, -10.0, 0.0]})), "optical", HERE), "missing_raster_file": (gone, optical(), "optical", HERE),
    }
    found, _ = detected(spark, cases, detection.ChangeConfig(mask_clouds=False))
    assert {k: (r.status, r.summary) for k, r in found.items()} == {k: (k, None) for k in cases}
    assert all(r.warnings for r in found.values()) and found["missing_raster_file"].warnings == ["missing: missing_raster_file_a/B04"]
    with pytest.raises(ValueError):
        detection.ChangeConfig(min_valid_ratio=2)


def test_summary_leaves_out_what_is_not_finite(spark):
    frame = spark.createDataFrame([(1, x) for x in (1.0, math.nan, 3.0, math.inf, None)] + [(2, math.nan)], "pair_id long, magnitude double")
    got = {r.pair_id: r for r in change.summary(frame, 4).collect()}
    assert (got[1].n_valid, got[1].mean, got[1].max, got[1].std, got[1].median, got[1].valid_pixel_ratio, got[1].status) == (2, 2.0, 3.0, 1.0, 2.0, 0.5, "success")
    assert (got[2].n_valid, got[2].mean, got[2].status) == (0, None, "no_valid_pixels")


def suppressed(spark, matrix, status="success", modality="optical", **limits):
    results = spark.createDataFrame([("p", modality, status, ["before"])], "pair_id string, modality string, status string, warnings array<string>")
    rows = [] if matrix is None else [("p", i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    frame = spark.createDataFrame(rows, "pair_id string, r long, c long, magnitude double")
    out, pixels = suppression.suppress_changes(results, frame, suppression.SuppressionConfig(**limits), 64)
    return out.first(), pixels


def scene(*places, level=0.05, high=0.30, side=64):
    out = np.full((side, side), level)
    for r, c in places:
        out[r, c] = high
    return out


BLOCK = [(i, j) for i in range(10, 14) for j in range(10, 14)]


@pytest.mark.parametrize(
    ("matrix", "limits", "want"),
    [
        (np.zeros((64, 64)), {}, (0, 0)),
        (np.full((64, 64), 0.25), {}, (0, 0)),
        (scene(*BLOCK), {}, (16, 16)),
        (scene((5, 5)), {}, (1, 0)),
        (scene((5, 5), (5, 6), (6, 5)), {}, (3, 0)),
        (scene(*[(i, j) for i in (5, 6, 7) for j in (5, 6, 7)]), {"min_neighbors": 4, "min_region_area": 1}, (9, 5)),
        (scene(*[(5, j) for j in range(10)]), {}, (10, 8)),
        (scene((0, 0), (0, 1), (1, 0), (1, 1), (62, 62), (62, 63), (63, 62), (63, 63)), {}, (8, 8)),
        (scene(*[(i, j) for i in (5, 6, 7) for j in (5, 6)], (30, 30), (30, 31)), {"min_neighbors": 1}, (8, 6)),
        (scene(*BLOCK, level=0.10, high=0.18), {"min_threshold_offset": 0.08}, (0, 0)),
    ],
)
def test_confirmed_pixels(spark, matrix, limits, want):
    r, pixels = suppressed(spark, matrix, **limits)
    assert (r.status, r.candidate_pixels, r.confirmed_pixels, r.suppressed_pixels) == ("success", *want, want[0] - want[1])
    confirmed = pixels.where("area IS NOT NULL").collect()
    assert len(confirmed) == want[1] and all(0.05 <= p.confidence <= 1 for p in confirmed)
    if confirmed:
        assert r.max_confidence == round(max(p.confidence for p in confirmed), 6) and r.confirmed_change_ratio == round(want[1] / 4096, 6)
    else:
        assert r.mean_confidence is None


def test_what_is_not_finite_is_no_pixel(spark):
    matrix = scene(*BLOCK)
    matrix[11, 11], matrix[40, 40], matrix[12, 14] = math.nan, math.inf, -math.inf
    r, _ = suppressed(spark, matrix)
    assert (r.valid_pixels, r.candidate_pixels, r.confirmed_pixels) == (4093, 15, 15)


def test_results_that_are_passed_on(spark):
    r, _ = suppressed(spark, scene(*BLOCK), "crs_mismatch")
    assert (r.status, r.method, r.candidate_pixels, r.threshold_used, r.warnings) == ("crs_mismatch", "unsupported", 0, None, ["before"])
    assert suppressed(spark, scene(*BLOCK), modality="sar")[0].status == "unsupported_sar_unaligned"
    assert suppressed(spark, None)[0].status == "missing_change_data"
    assert suppressed(spark, np.full((64, 64), math.nan))[0].status == "no_valid_pixels"
    assert suppressed(spark, scene()[:9, :9])[0].status == "insufficient_valid_pixels"
    for bad in ({"sensitivity_k": -1.0}, {"sensitivity_k": math.nan}, {"min_neighbors": 9}, {"min_region_area": 0}, {"min_valid_pixels": 0}):
        with pytest.raises(ValueError):
            suppression.SuppressionConfig(**bad)
    for bad in ({"sensitivity_k": True}, {"min_neighbors": 2.0}, {"min_region_area": "4"}):
        with pytest.raises(TypeError):
            suppression.SuppressionConfig(**bad)


# ---------------------------------------------------------------- index and search


def eight(spark):
    rows = []
    for i in range(8):
        radar, date = i >= 4, ["2022-01-20T10:00:00Z", "2022-01-21T10:00:00Z", "2024-01-10T12:00:00Z", "2024-01-11T12:00:00Z"][i % 4]
        name, west, south = ("sar" if radar else "opt"), round(73 + 0.1 * (i % 4), 1), 19.1 if radar else 19.0
        rows.append((f"tile_{name}_{i}", f"scene_{name}_{1 + i % 4 // 2}", "sar" if radar else "optical", "d", [west, south, round(west + 0.1, 1), round(south + 0.1, 1)], date, [float(i == k) for k in range(8)]))
    frame = spark.createDataFrame(rows, "tile_id string, scene_id string, modality string, tile_directory string, bounds_wgs84 array<double>, acquisition_datetime_utc string, embedding array<float>")
    return index.index_entries(frame.select("tile_id", "scene_id", "modality", "embedding"), frame.drop("scene_id", "modality", "embedding"))


def test_filters_and_their_errors(spark):
    engine = index.TextSearch(index.with_row_ids(eight(spark)), embedding.HashEmbedder(8), 8)
    query = np.ones(8) / np.sqrt(8)
    found = lambda **m: {r.tile_id[5:] for r in engine.search(query, **m).collect()}
    assert found(date_from="2022-01-20", date_to="2022-01-20") == {"opt_0", "sar_4"}
    assert found(bbox=[73.05, 19.05, 73.15, 19.15]) == {"opt_0", "opt_1", "sar_4", "sar_5"}
    assert found(bbox=(73.1, 19.1, 73.1, 19.1)) == {"opt_0", "opt_1", "sar_4", "sar_5"}
    assert found(modality=" Optical ", date_from="2022-01-20T10:00:00Z", date_to=datetime.date(2022, 1, 20), scene_id=" scene_opt_1 ", bbox=[73.0, 19.0, 73.05, 19.05]) == {"opt_0"}
    assert found(modality="sar", scene_id="scene_opt_1") == set()
    for bad in ({"top_k": 0}, {"modality": "radio"}, {"date_from": "2024-01-02", "date_to": "2024-01-01"}, {"scene_id": " "}, {"bbox": [1, 2, 3]}, {"bbox": [2, 0, 1, 1]}, {"date_to": "never"}):
        with pytest.raises(ValueError):
            found(**bad)
    for bad in ({"top_k": True}, {"top_k": 1.5}, {"modality": 5}, {"scene_id": 5}, {"bbox": "abcd"}, {"bbox": [True, 0, 1, 1]}, {"date_from": 5}):
        with pytest.raises(TypeError):
            found(**bad)
    for bad in (np.zeros(8), np.ones(7), np.ones((2, 8))):
        with pytest.raises(ValueError):
            engine.search(bad)
    with pytest.raises(TypeError):
        engine.search(5)
    with pytest.raises(ValueError):
        engine.search("  ")
    row = engine.search("ships in a harbour", 3).collect()
    assert [r.rank for r in row] == [1, 2, 3] and json.loads(row[0].metadata)["tile_id"] == row[0].tile_id and len(row[0]) == 10
    assert engine.like_tile("tile_sar_6", 1).first().tile_id == "tile_sar_6"
    with pytest.raises(KeyError):
        engine.like_tile("none")


def test_near_scores_rank_as_they_were_chosen(spark):
    """Scores that are the same to 6 places and not to 12: the ids' order is the other way."""
    angle = {"d": 1e-5, "c": 2e-4, "b": 4e-4, "a": 6e-4, "far": 1.0}
    rows = [(t, "s", "optical", "d", None, None, [float(np.cos(x)), float(np.sin(x))]) for t, x in angle.items()]
    entries = spark.createDataFrame(rows, "tile_id string, scene_id string, modality string, tile_directory string, bounds_wgs84 array<double>, acquisition_datetime_utc string, embedding array<double>")
    found = index.hits(entries, [1.0, 0.0], 4).orderBy("rank").collect()
    assert [r.tile_id for r in found] == ["d", "c", "b", "a"]
    assert [r.similarity_score for r in found] == [1.0] * 4


def test_ties_rank_by_id_and_rows_are_numbered(spark):
    same = [(t, "s", "optical", "d", None, None, [1.0, 0.0]) for t in ("charlie", "alpha", "bravo")]
    frame = spark.createDataFrame(same, "tile_id string, scene_id string, modality string, tile_directory string, bounds_wgs84 array<double>, acquisition_datetime_utc string, embedding array<float>")
    assert [r.tile_id for r in index.hits(frame, [1.0, 0.0], 5).collect()] == ["alpha", "bravo", "charlie"]
    numbered = index.with_row_ids(eight(spark))
    assert [r.tile_id[5:] for r in numbered.orderBy("row_id").collect()] == ["sar_4", "sar_5", "sar_6", "sar_7", "opt_0", "opt_1", "opt_2", "opt_3"]
    assert index.by_row(numbered, 4).first().tile_id == "tile_opt_0" and index.by_tile(numbered, "none").isEmpty()
    with pytest.raises(IndexError):
        index.by_row(numbered, 8)


def test_an_index_is_checked_on_every_way_in(spark, tmp_path):
    whole = eight(spark)
    index.save(whole, f"{tmp_path}/index", 8)
    assert index.load(spark, f"{tmp_path}/index", 8, 8).count() == 8
    with pytest.raises(ValueError, match="rows"):
        index.load(spark, f"{tmp_path}/index", 8, 9)
    with pytest.raises(ValueError):
        index.load(spark, f"{tmp_path}/index", 16)
    scaled = lambda f: whole.limit(1).withColumns({"tile_id": F.lit("new"), "embedding": F.transform("embedding", lambda x: (x * f).cast("float"))})
    assert index.add_vectors(whole, scaled(1.0019), 8).count() == 9
    for bad in (scaled(1.0021), whole.limit(1), scaled(1.0).withColumn("tile_id", F.lit(None).cast("string")), scaled(0.0)):
        with pytest.raises(ValueError):
            index.add_vectors(whole, bad, 8)
    counts = {(r.modality, r.scene_id): r.n for r in index.group_counts(whole).collect()}
    assert counts[("optical", None)] == 4 and counts[(None, "scene_sar_2")] == 2


def test_search_of_many_queries_against_brute_force(spark):
    draw = np.random.default_rng(42)
    data = draw.standard_normal((120, 16)).astype(np.float32)
    data[60:90] = data[30:60]  # ties
    names = [f"t{i:03d}" for i in range(120)]
    frame = spark.createDataFrame(list(zip(names, data.tolist(), strict=True)), "id string, embedding array<float>").repartition(5)
    queries = frame.where(F.substring("id", 2, 3).cast("int") % 7 == 0)
    got = {}
    for r in search.search_all(queries, frame, 6, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q in range(0, 120, 7):
        scores = np.floor(data.astype(float) @ data[q].astype(float) * 1e6 + 0.5) / 1e6
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], names[i]))[:6]
        assert [got[names[q]][k] for k in range(1, 7)] == [names[i] for i in want]
    assert search.search_all(frame.limit(0), frame, 3).count() == 0


def test_blocks_of_both_sides_are_stored_once(spark):
    """No row is copied for the blocks that it meets, and lists and ranks of many blocks equal sums in order."""
    draw = np.random.default_rng(7)
    data = draw.standard_normal((700, 24)).astype(np.float32)
    data[350:] = data[:350]  # every vector twice
    frame = spark.createDataFrame(list(enumerate(data.tolist())), "id long, embedding array<float>").repartition(3)
    goals = frame.selectExpr("id", "embedding", "id * 13 % 700 AS target_id").join(frame.selectExpr("id AS target_id", "embedding AS target_embedding"), "target_id")
    near, ranks = search.search_all(frame, frame, 4, block=50), search.target_ranks(goals, frame, block=50)
    for made in (near, ranks):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan
    wide = data.astype(float)
    total = np.zeros((700, 700))
    for i in range(24):
        total += wide[:, None, i] * wide[None, :, i]
    scores, got = np.floor(total * 1e12 + 0.5) / 1e12, {}
    for r in near.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q in range(700):
        assert [got[q][k] for k in range(1, 5)] == sorted((i for i in range(700) if i != q), key=lambda i: (-scores[q, i], i))[:4]
    for r in ranks.collect():
        t = r.query_id * 13 % 700
        assert r["rank"] == 1 + int(((scores[r.query_id] > scores[r.query_id, t]) | ((scores[r.query_id] == scores[r.query_id, t]) & (np.arange(700) < t))).sum())


# ---------------------------------------------------------------- evaluation


def test_fourteen_measures_against_numpy(spark):
    images = [(f"{c}_{i}.jpg", c) for c, n in (("airport", 9), ("beach", 7), ("lone", 1)) for i in range(n)]
    captions = [(f"{i}_cap_{k}", i, "x") for i, _ in images for k in range(2)]
    frame, lines = spark.createDataFrame(images, "image_id string, category string"), spark.createDataFrame(captions, "caption_id string, image_id string, text string")
    pictures, texts = (evaluation.random_vectors(f, 8, s) for f, s in ((frame.select(F.col("image_id").alias("id")), 1), (lines.select(F.col("caption_id").alias("id")), 2)))
    got = {(r.task, r.measure): r.value for r in evaluation.evaluate(frame, lines, pictures, texts).collect()}
    p, t = ({r.id: np.array(r.embedding, float) for r in f.collect()} for f in (pictures, texts))
    kind = dict(images)
    order = lambda v, skip=None: sorted((i for i in p if i != skip), key=lambda i: (-math.floor(p[i] @ v * 1e6 + 0.5) / 1e6, i))
    place = [order(t[c]).index(i) + 1 for c, i, _ in captions]
    want = {("text_to_image_instance", f"Recall@{k}"): np.mean([r <= k for r in place]) for k in (1, 5, 10)} | {("text_to_image_instance", "MRR"): np.mean([1 / r for r in place])}

    def graded(task, lists, totals, depth, recall, precision=(), ndcg=False):
        lists = [x[:depth] for x in lists]
        out = {(task, f"Recall@{k}"): np.mean([sum(x[:k]) / max(n, 1) for x, n in zip(lists, totals, strict=True)]) for k in recall}
        out |= {(task, f"Precision@{k}"): np.mean([sum(x[:k]) / k for x in lists]) for k in precision}
        some = [(x, n) for x, n in zip(lists, totals, strict=True) if n]
        out[task, f"mAP@{depth}"] = np.mean([sum(sum(x[: k + 1]) / (k + 1) for k, h in enumerate(x) if h) / min(n, depth) for x, n in some])
        if ndcg:
            out[task, f"nDCG@{depth}"] = np.mean([sum(h / math.log2(k + 2) for k, h in enumerate(x)) / sum(1 / math.log2(k + 2) for k in range(min(n, depth))) for x, n in some])
        return out

    size = {c: sum(k == c for k in kind.values()) for c in kind.values()}
    want |= graded("text_to_image_category", [[kind[j] == kind[i] for j in order(t[c])] for c, i, _ in captions], [size[kind[i]] for _, i, _ in captions], 20, (5, 10, 20), ndcg=True)
    want |= graded("image_to_image_class", [[kind[j] == kind[i] for j in order(p[i], i)] for i in kind], [size[kind[i]] - 1 for i in kind], 50, (10,), (1, 5, 10))
    assert len(got) == 14 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want), {k: (got[k], want[k]) for k in want}


def test_manifests(spark):
    split = spark.createDataFrame([("x/storage_tank_15.jpg", bytearray(b"abc"), [" a tank ", "tanks"]), ("odd.jpg", bytearray(b""), [])], "filename string, image binary, captions array<string>")
    images, captions = evaluation.items_of(split)
    assert {(r.image_id, r.category) for r in images.collect()} == {("storage_tank_15.jpg", "storage tank"), ("odd.jpg", "unknown")}
    assert {(r.caption_id, r.text) for r in captions.collect()} == {("storage_tank_15.jpg_cap_0", "a tank"), ("storage_tank_15.jpg_cap_1", "tanks")}
    r = evaluation.manifest_summary(images, captions).first()
    assert (r.image_count, r.caption_count, r.category_count, r.categories) == (2, 2, 2, ["storage tank", "unknown"])
    files = spark.createDataFrame([("odd.jpg",), ("more.jpg",)], "name string")
    r = evaluation.overlap(files, images).first()
    assert (r.n_files, r.n_items, r.n_both, r.complete) == (2, 2, 1, False)


# ---------------------------------------------------------------- files


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float32"])
def test_geotiff_round_trip(kind):
    values = (np.arange(35 * 21).reshape(35, 21) % 251).astype(kind)
    affine = [10.0, 0.0, 300000.0, 0.0, -10.0, 2100000.0]
    got = geotiff.decode(geotiff.encode(values, affine, UTM, 0))
    assert (got["height"], got["width"], got["dtype"], got["crs"], got["affine"], got["nodata"]) == (35, 21, kind, UTM, affine, 0.0)
    assert (got["data"] == values).all()
    points = [(0.0, 0.0, 73.0, 19.0, 5.0), (9.0, 0.0, 73.1, 19.0, 6.0)]
    got = geotiff.decode(geotiff.encode(values, gcps=points))
    assert (got["gcps"], got["affine"], got["crs"], got["nodata"]) == (points, None, "EPSG:4326", None)
    for bad in (b"", b"II*\0", b"PNG and more"):
        with pytest.raises(Exception):  # noqa: B017
            geotiff.decode(bad)


def optical_folder(path, size=300, **changes):
    path.mkdir(parents=True)
    bands = {}
    for band in scenes.OPTICAL_BANDS:
        layer = band == "SCL"
        side, step = (size // 2, 20.0) if layer else (size, 10.0)
        content = geotiff.encode(np.full((side, side), 4 if layer else 1000, "uint8" if layer else "uint16"), [step, 0.0, 300000.0, 0.0, -step, 2100000.0], UTM, None if layer else 0)
        (path / f"{band}.tif").write_bytes(content)
        import hashlib

        bands[band] = {"local_filename": f"{band}.tif", "local_sha256": hashlib.sha256(content).hexdigest(), "pixel_resolution_m": step, "dimensions": {"height": side, "width": side}}
    document = {"scene_metadata": {"scene_id": path.name, "acquisition_datetime": changes.pop("when", "2023-01-01T10:00:00Z")}, "bands": bands, "provenance": {}}
    (path / "metadata.json").write_text(json.dumps(document | changes))


def test_optical_scenes_are_validated_and_tiled(spark, tmp_path):
    optical_folder(tmp_path / "good" / "s1")
    tiles, made = workflows.tile_optical(spark, f"{tmp_path}/good")
    rows = {r.tile_id: r for r in tiles.collect()}
    assert rows.keys() == {f"s2_s1_10m_r0{i}_c0{j}" for i in (0, 1) for j in (0, 1)}
    corner = rows["s2_s1_10m_r01_c01"]
    assert (corner.row_off, corner.col_off, corner.half_row_off, corner.bounds_projected) == (44, 44, 22, [300440.0, 2097000.0, 303000.0, 2099560.0])
    assert 73 < corner.bounds_wgs84[0] < corner.bounds_wgs84[2] < 74
    found = {(r.tile_id, r.band): r for r in made.collect()}
    assert len(found) == 20 and found[corner.tile_id, "SCL"].height == 128 and found[corner.tile_id, "B04"].statistics.mean == 1000.0
    assert geotiff.decode(bytes(found[corner.tile_id, "B04"].content))["affine"] == [10.0, 0.0, 300440.0, 0.0, -10.0, 2099560.0]
    again = {(r.tile_id, r.band): r.sha256 for r in workflows.tile_optical(spark, f"{tmp_path}/good")[1].collect()}
    assert again == {k: r.sha256 for k, r in found.items()}
    assert tiling.manifests(tiles).first().total_tiles == 4
    assert scenes.unmodified(spark, f"{tmp_path}/good").first().unmodified
    optical_folder(tmp_path / "bad" / "s2")
    (tmp_path / "bad" / "s2" / "B03.tif").unlink()
    (tmp_path / "bad" / "s2" / "B04.tif").write_bytes(geotiff.encode(np.full((10, 10), 60000, "uint16"), [10.0, 0.0, 0.0, 0.0, -10.0, 0.0], UTM, 5))
    row = scenes.optical_scenes(spark, f"{tmp_path}/bad")[0].first()
    assert row.status == "FAILED" and set(row.errors) == {"missing band B03", "B04: dimensions", "B04: sha256"} and set(row.warnings) == {"B04: nodata is not 0", "B04: bright pixels"}
    assert not scenes.unmodified(spark, f"{tmp_path}/bad").first().unmodified
    with pytest.raises(ValueError, match="s2"):
        workflows.tile_optical(spark, f"{tmp_path}/bad")


def radar_folder(path, side=300, moved=0.0, parts=scenes.PROVENANCE):
    import hashlib

    path.mkdir(parents=True)
    bands = {}
    for band in scenes.RADAR_BANDS:
        content = geotiff.encode(np.full((side, side), 500, "uint16"), nodata=0)
        (path / f"{band.lower()}.tif").write_bytes(content)
        bands[band] = {"local_sha256": hashlib.sha256(content).hexdigest()}
    points = [{"id": str(i), "source_col": 1000 + x, "source_row": 2000 + y, "local_col": x + moved, "local_row": y, "lon": 73 + x * 1e-4, "lat": 19 - y * 1e-4, "elevation_m": 3.0} for i, (x, y) in enumerate([(0, 0), (300, 0), (0, 300), (300, 300)])]
    document = {"scene_metadata": {"scene_id": path.name, "acquisition_datetime_utc": "2023-01-01T10:00:00Z"}, "bands": bands, "crop_window": {"col_off": 1000, "row_off": 2000, "width": side, "height": side}, "local_gcps": points, "provenance": dict.fromkeys(parts, "x")}
    (path / "metadata.json").write_text(json.dumps(document))


def test_radar_scenes_are_validated_and_tiled(spark, tmp_path):
    radar_folder(tmp_path / "good" / "r1")
    tiles, made = workflows.tile_radar(spark, f"{tmp_path}/good")
    corner = tiles.where("tile_id = 's1_r1_radar_r01_c01'").first()
    assert (corner.abs_col_off, corner.abs_row_off, [(g.tile_col, g.tile_row) for g in corner.tile_gcps]) == (1044, 2044, [(-44.0, -44.0), (256.0, -44.0), (-44.0, 256.0), (256.0, 256.0)])
    assert corner.bounds_wgs84 == [73.0044, 18.97, 73.03, 18.9956] and corner.fit.rmse_metres == 0.0
    assert made.count() == 8
    radar_folder(tmp_path / "bad" / "r2", moved=1.0, parts=scenes.PROVENANCE[1:])
    row = scenes.radar_scenes(spark, f"{tmp_path}/bad")[0].first()
    assert set(row.errors) == {"control points misplaced", f"provenance lacks {scenes.PROVENANCE[0]}"}


def test_staged_embeddings(spark, tmp_path):
    folder = tmp_path / "sentinel2" / "s1"
    folder.mkdir(parents=True)
    np.save(folder / "embeddings.npy", np.eye(3, dtype=np.float32))
    manifest = {"source_scene_id": "s1", "modality": "optical", "embeddings_file": "embeddings.npy", "tile_ids": ["a", "b", "c"]}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    assert {r.tile_id: r.embedding for r in tables.staged_embeddings(spark, str(tmp_path)).collect()}["b"] == [0.0, 1.0, 0.0]
    (folder / "manifest.json").write_text(json.dumps(manifest | {"tile_ids": ["a"]}))
    with pytest.raises(ValueError):
        tables.staged_embeddings(spark, str(tmp_path))
    (folder / "manifest.json").write_text(json.dumps(manifest | {"embeddings_file": "gone.npy"}))
    with pytest.raises(FileNotFoundError):
        tables.staged_embeddings(spark, str(tmp_path))
    r = tables.staged_model(spark, str(tmp_path)).first()
    assert (r.n_files, r.staged) == (2, False)


def test_array_statistics(spark):
    frame = spark.createDataFrame([([100, 200, 300, 400], None), ([0, 200, 0, 400], 0), ([0, 0], 0), ([], None), ([20000, 5], None)], "d array<int>, n int")
    got = [r.s for r in frame.select(stats.array_statistics(F.col("d"), F.col("n")).alias("s")).collect()]
    assert (got[0].mean, got[0].n_valid, got[0].p50, got[0].p1) == (250.0, 4, 250.0, 103.0)
    assert (got[1].mean, got[1].n_valid, got[1].n_total) == (300.0, 2, 4)
    assert [g.max for g in got[2:4]] == [0.0, 0.0] and (got[4].n_above, got[4].pct_above) == (1, 50.0)
    layer = one(spark, stats.class_report(F.array(*map(F.lit, (8, 9, 10, 3, 4, 4, 6, 5)))).alias("c")).c
    assert (layer.cloud_pct, layer.shadow_pct, layer.vegetation_pct, layer.counts[4]) == (37.5, 12.5, 25.0, 2)


def test_commands(spark, tmp_path, capsys):
    from terraquarry import cli

    index.save(eight(spark), f"{tmp_path}/index", 8)
    args = lambda *a: cli.run(spark, cli.parser().parse_args([*a, "--index", f"{tmp_path}/index"]))
    assert args("search", "a port", "--top-k", "2", "--modality", "sar", "--dimension", "8").count() == 2
    assert args("index", "--inspect", "--dimension", "8").count() == 6
    assert args("index", "--search-tile", "tile_opt_1", "--top-k", "1", "--dimension", "8").first().tile_id == "tile_opt_1"
    assert cli.main(["pair", "--index", f"{tmp_path}/index", "--tile-id", "none"]) == 1
    assert "none" in capsys.readouterr().err
