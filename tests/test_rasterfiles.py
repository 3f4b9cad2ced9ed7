"""Windows of raster files, files written by tasks, and the way from scene folders to confirmed maps."""

import hashlib
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquarry.operators import pairing, suppression
from terraquarry.plans import workflows
from terraquarry.sources import geotiff, rasterfiles

UTM = "EPSG:32643"
AFFINE = [10.0, 0.0, 300000.0, 0.0, -10.0, 2100000.0]


def band(side=1024, seed=1, kind="uint16"):
    return np.random.default_rng(seed).integers(0, 4000, (side, side)).astype(kind)


def test_windows_of_blocked_and_stripped_files():
    values = band(300)
    for block in (None, 16, 64, 512):
        data = geotiff.encode(values, AFFINE, UTM, 0, block=block)
        head = geotiff.header(data)
        assert (geotiff.decode(data)["data"] == values).all() and head["affine"] == AFFINE
        for row, column, height, width in ((0, 0, 300, 300), (17, 250, 60, 40), (299, 299, 1, 1), (290, 10, 30, 5), (-3, -2, 9, 9)):
            got = geotiff.window(data, head, row, column, height, width)
            want = np.pad(values, 40)[row + 40 : row + 40 + height, column + 40 : column + 40 + width]
            assert (got == want).all(), (block, row, column)


def test_a_window_reads_in_proportion_to_its_size(tmp_path):
    path = tmp_path / "b.tif"
    path.write_bytes(geotiff.encode(band(), AFFINE, UTM, 0, block=64))
    read = {side: rasterfiles._read(str(path), 128, 192, side, side)[1] for side in (64, 128, 256, 1024)}
    size = path.stat().st_size
    directory = read[64] - size // 256
    assert read[64] < size / 50 and read[1024] < 1.1 * size + directory
    for small, large in ((64, 128), (128, 256)):
        assert 3.5 < (read[large] - directory) / (read[small] - directory) < 4.5


def test_filters_reach_the_files(spark, tmp_path):
    for name in ("B02", "B04"):
        (tmp_path / "s1").mkdir(exist_ok=True)
        (tmp_path / "s1" / f"{name}.tif").write_bytes(geotiff.encode(band(600, ord(name[2])), AFFINE, UTM, 0, block=128))
    (tmp_path / "s1" / "plain.tif").write_bytes(geotiff.encode(band(40)))
    windows = rasterfiles.read_windows(spark, str(tmp_path), 256)
    assert windows.count() == 9 + 9 + 1
    some = windows.where("band = 'B04' AND west < 303000 AND east > 300100 AND north >= 2097440 AND south <= 2099990")
    assert some.rdd.getNumPartitions() == 4  # windows that the filters leave, and no others
    rows = {(r.row_off, r.col_off): r for r in some.collect()}
    assert rows.keys() == {(0, 0), (0, 256), (256, 0), (256, 256)}
    whole = band(600, ord("4"))
    for (row, column), r in rows.items():
        assert (np.array(r.data).reshape(r.height, r.width) == whole[row : row + 256, column : column + 256]).all()
        assert (r.west, r.north, r.affine[2], r.affine[5]) == (300000.0 + 10 * column, 2100000.0 - 10 * row) * 2
    assert windows.where("band IN ('B02') AND row_off = 512").agg(F.sum("height"), F.sum("width")).first()[:] == (3 * 88, 600)
    assert windows.where("west IS NULL").select("band").first().band == "plain" and windows.where("band = 'B99'").count() == 0
    with pytest.raises(ValueError):
        rasterfiles.local_path("s3://bucket/x")


def rasters(spark, names, kind="uint16", side=40):
    rows = [(n, side, side, kind, UTM, AFFINE, 0.0, [float(x) for x in band(side, i).ravel()]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "name string, height int, width int, dtype string, crs string, affine array<double>, nodata double, data array<float>").repartition(3)


def files_below(path):
    return sorted(os.path.relpath(os.path.join(f, n), path) for f, _, names in os.walk(path) for n in names)


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "out")
    rasterfiles.write_rasters(rasters(spark, ["a/x.tif", "b/y.tif", "z.tif"]), target, block=16)
    assert files_below(target) == ["a/x.tif", "b/y.tif", "z.tif"]
    got = geotiff.decode(open(f"{target}/b/y.tif", "rb").read())
    assert (got["data"] == band(40, 1)).all() and (got["affine"], got["crs"], got["dtype"]) == (AFFINE, UTM, "uint16")
    before = {n: open(f"{target}/{n}", "rb").read() for n in files_below(target)}
    for bad in (["new.tif", "z.tif"], ["new.tif", "../out.tif"], ["one.tif", "one.tif"], ["new.tif", ""]):
        with pytest.raises(Exception):  # noqa: B017
            rasterfiles.write_rasters(rasters(spark, bad), target)
        assert {n: open(f"{target}/{n}", "rb").read() for n in files_below(target)} == before
    torn = rasters(spark, [f"t{i}.tif" for i in range(9)]).withColumn("width", F.when(F.col("name") == "t7.tif", 41).otherwise(F.col("width")))
    with pytest.raises(Exception):  # noqa: B017
        rasterfiles.write_rasters(torn, str(tmp_path / "torn"))
    assert files_below(tmp_path / "torn") == []
    rasterfiles.write_rasters(rasters(spark, ["z.tif"], side=16), target, overwrite=True)
    assert geotiff.decode(open(f"{target}/z.tif", "rb").read())["height"] == 16


def folder(path, when, change=(), size=300):
    path.mkdir(parents=True)
    bands = {}
    for name in ("B02", "B03", "B04", "B08", "SCL"):
        layer = name == "SCL"
        side, step = (size // 2, 20.0) if layer else (size, 10.0)
        values = np.full((side, side), 4, "uint8") if layer else (1000 + np.random.default_rng(ord(name[2])).integers(0, 40, (side, side))).astype("uint16")
        if not layer:
            for r, c, n in change:
                values[r : r + n, c : c + n] += 2500
        content = geotiff.encode(values, [step, 0.0, 300000.0, 0.0, -step, 2100000.0], UTM, None if layer else 0, block=64)
        (path / f"{name}.tif").write_bytes(content)
        bands[name] = {"local_filename": f"{name}.tif", "local_sha256": hashlib.sha256(content).hexdigest(), "pixel_resolution_m": step, "dimensions": {"height": side, "width": side}}
    (path / "metadata.json").write_text(json.dumps({"scene_metadata": {"scene_id": path.name, "acquisition_datetime": when}, "bands": bands, "provenance": {}}))


def test_from_scene_folders_to_confirmed_maps(spark, tmp_path):
    """Two scenes, a change of 6 x 6 pixels that lies in all four tiles and a single pixel that is noise: files of maps, in under a minute."""
    start = time.monotonic()
    folder(tmp_path / "scenes" / "s1", "2023-01-01T10:00:00Z")
    folder(tmp_path / "scenes" / "s2", "2023-02-01T10:00:00Z", [(100, 120, 6), (60, 60, 1)])
    tiles, made = workflows.tile_optical(spark, str(tmp_path / "scenes"))
    workflows.write_tiles(tiles, made, str(tmp_path / "made"))
    tiles, made = spark.read.parquet(f"{tmp_path}/made/tiles"), spark.read.parquet(f"{tmp_path}/made/rasters")
    found = workflows.compare(workflows.index_tiles(tiles, "d"), made)
    changes = {r.pair_id: r for r in found["changes"].drop("magnitude").collect()}
    assert len(changes) == 4 and {r.status for r in changes.values()} == {"success"}
    sure = {r.pair_id: (r.candidate_pixels, r.confirmed_pixels) for r in found["suppressed"].collect()}
    assert all(v == (37, 36) for v in sure.values()), sure
    headers, _ = workflows.headers_and_pixels(made)
    rasterfiles.write_rasters(workflows.change_maps(found["changes"], headers), str(tmp_path / "maps"))
    rasterfiles.write_rasters(workflows.confirmed_maps(found["changes"], found["candidates"], headers), str(tmp_path / "maps"))
    assert len(files_below(tmp_path / "maps")) == 12
    for pair, r in changes.items():
        load = lambda kind: geotiff.decode((tmp_path / "maps" / f"{kind}__{pair}.tif").read_bytes())  # noqa: B023, E731
        mask, sureness, change = load("mask"), load("confidence"), load("change")
        row, column = 44 * ("r01" in r.reference_tile_id), 44 * ("c01" in r.reference_tile_id)
        want = np.zeros((256, 256), np.uint8)
        want[100 - row : 106 - row, 120 - column : 126 - column] = 1
        assert (mask["data"] == want).all() and mask["dtype"] == "uint8" and ((sureness["data"] > 0) == (want > 0)).all()
        assert change["affine"] == [10.0, 0.0, 300000.0 + 10 * column, 0.0, -10.0, 2100000.0 - 10 * row] and change["data"].max() > 0.4
    assert time.monotonic() - start < 60
    # magnitudes that are not at hand come from the files; a pair without either has a status of its own
    gone = found["changes"].withColumn("magnitude", F.lit(None).cast("array<float>"))
    (tmp_path / "maps" / f"change__{min(changes)}.tif").unlink()
    again = suppression.suppress_rasters(gone, files=workflows.stored_magnitudes(spark, str(tmp_path / "maps")))
    rows = {r.pair_id: (r.status, r.confirmed_pixels, len(r.pixels or [])) for r in again.collect()}
    assert rows.pop(min(changes)) == ("missing_raster_file", 0, 0) and set(rows.values()) == {("success", 36, 37)} and len(rows) == 3
    assert {(r.status, r.candidate_pixels) for r in suppression.suppress_rasters(found["changes"]).collect()} == {("success", 37)}
    assert {r.status for r in suppression.suppress_rasters(gone).collect()} == {"missing_change_data"}


def test_maps_are_merged(spark):
    from terraquarry.functions import scalars

    frame = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": None}), ({"a": 1}, None), (None, {"z": 9}), (None, None), ({}, {})], "x map<string,int>, y map<string,int>")
    got = [r.m for r in frame.select(scalars.merged(F.col("x"), F.col("y")).alias("m")).collect()]
    assert got == [{"a": 1, "b": 3, "c": None}, {"a": 1}, {"z": 9}, None, {}]


def test_radar_files_carry_control_points(spark, tmp_path):
    from test_core import radar_folder

    radar_folder(tmp_path / "scenes" / "r1")
    tiles, made = workflows.tile_radar(spark, str(tmp_path / "scenes"))
    workflows.write_tile_files(tiles, made, str(tmp_path / "files"), block=64)
    assert len(files_below(tmp_path / "files")) == 8
    name = tiles.where("row_idx = 1 AND col_idx = 1").first().tile_id
    got = geotiff.decode((tmp_path / "files" / "sar" / "r1" / name / "VV.tif").read_bytes())
    assert (got["height"], got["crs"], len(got["gcps"])) == (256, "EPSG:4326", 4) and (got["data"] == 500).all()
    assert got["gcps"][0][:2] == (-44.0, -44.0) and got["gcps"][3][2:] == pytest.approx((73.03, 18.97, 3.0))
    content = {(r.tile_id, r.band): bytes(r.content) for r in made.select("tile_id", "band", "content").collect()}
    assert geotiff.decode(content[name, "VV"])["gcps"] == got["gcps"]


def test_commands_over_folders(spark, tmp_path):
    from terraquarry import cli

    folder(tmp_path / "scenes" / "s1", "2023-01-01T10:00:00Z")
    folder(tmp_path / "scenes" / "s2", "2023-02-01T10:00:00Z", [(100, 120, 6)])
    run = lambda *a: cli.run(spark, cli.parser().parse_args([*a]))
    assert run("tile", "--optical", f"{tmp_path}/scenes", "--output-dir", f"{tmp_path}/made", "--files").where("modality IS NULL").first().total_tiles == 8
    assert len(files_below(tmp_path / "made" / "tile_optical" / "files")) == 40
    tiles = spark.read.parquet(f"{tmp_path}/made/tile_optical/tiles")
    workflows.index_tiles(tiles, "d").write.parquet(f"{tmp_path}/index")
    given = ("--index", f"{tmp_path}/index", "--rasters", f"{tmp_path}/made/tile_optical/rasters", "--output-dir", f"{tmp_path}/maps")
    assert run("change", *given, "--save-map").count() == 4
    rows = run("suppress", *given, "--save-masks", "--min-neighbors", "3").collect()
    assert {r.confirmed_pixels for r in rows} == {36} and len(files_below(tmp_path / "maps")) == 12
    first = pairing.in_order(pairing.all_tile_pairs(spark.read.parquet(f"{tmp_path}/index"))).first()
    assert run("change", *given, "--tile-id", first.reference_tile_id).count() == 1


def test_from_scene_folders_to_a_searched_index(spark, tmp_path):
    """Tiles become images, images vectors, vectors an index of parts; a tile's bytes are those of the plain formula."""
    from terraquarry.operators import embedding, index, parts

    folder(tmp_path / "scenes" / "s1", "2023-01-01T10:00:00Z", [(100, 120, 6)])
    tiles, made = workflows.tile_optical(spark, str(tmp_path / "scenes"))
    workflows.write_tiles(tiles, made, str(tmp_path / "made"))
    tiles, made = spark.read.parquet(f"{tmp_path}/made/tiles"), spark.read.parquet(f"{tmp_path}/made/rasters")
    bands = {r.band: np.array(r.data) for r in made.where("tile_id LIKE '%r00_c00'").collect()}
    image = np.stack([np.round(np.clip(bands[b] / 10000, 0, 0.35) / 0.35 * 255) for b in ("B04", "B03", "B02")], -1).astype(int).ravel()
    (row,) = workflows.images(tiles.where("tile_id LIKE '%r00_c00'"), made).collect()
    assert (row.height, row.width) == (256, 256) and (np.array(row.values) == image).all()
    embedder = embedding.HashEmbedder(16)
    vectors = workflows.embed_tiles(tiles, made, embedder)
    want = embedder.encode_images([image.astype(np.uint8).reshape(256, 256, 3)])[0]
    found = {r.tile_id: np.array(r.embedding) for r in vectors.collect()}
    assert len(found) == 4 and np.allclose(found[row.tile_id], want, atol=1e-6)
    built = index.checked(index.index_entries(vectors, workflows.index_tiles(tiles, "d")), 16)
    parts.create(spark, f"{tmp_path}/index", 16)
    for scene in ("c00", "c01"):
        parts.append(f"{tmp_path}/index", built.where(f"tile_id LIKE '%{scene}'"))
    search = index.TextSearch(parts.load(spark, f"{tmp_path}/index", verify=True), embedder, 16)
    nearest = search.like_tile(row.tile_id, 4).collect()
    assert nearest[0].tile_id == row.tile_id and nearest[0].similarity_score == pytest.approx(1, abs=1e-5) and len(nearest) == 4
    assert search.search("a bridge", 2, modality="optical").count() == 2
