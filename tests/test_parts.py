"""An index of parts: what an append reads, refuses and leaves behind."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquarry.operators import parts


def rows(spark, ids, dimension=8, seed=1):
    data = np.random.default_rng(seed).standard_normal((len(ids), dimension))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    return spark.createDataFrame([(i, "s", v.tolist()) for i, v in zip(ids, data)], "tile_id string, scene_id string, embedding array<float>")


def state(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/parts/*/*.parquet")}


def test_an_index_grows_by_parts(spark, tmp_path):
    path = f"{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        parts.manifest(spark, path)
    assert parts.create(spark, path, 8).rows == 0
    with pytest.raises(FileExistsError):
        parts.create(spark, path, 8)
    with pytest.raises(ValueError):
        parts.load(spark, path)
    parts.append(path, rows(spark, [f"a{i:03d}" for i in range(100)]))
    before = state(path)
    assert parts.append(path, rows(spark, ["b0"])).rows == 101
    assert before.items() <= state(path).items()  # what was there is not written anew
    assert parts.load(spark, path, verify=True).count() == 101
    merged = parts.compact(spark, path)
    assert (len(merged.parts), merged.rows) == (1, 101) and parts.load(spark, path, verify=True).count() == 101
    assert len(parts.vacuum(spark, path)) == 4 and parts.load(spark, path, verify=True).count() == 101


def test_an_append_reads_the_keys_of_parts_that_ids_can_lie_in(spark, tmp_path):
    path = f"{tmp_path}/index"
    parts.create(spark, path, 8)
    for letter in "abc":
        parts.append(path, rows(spark, [f"{letter}{i}" for i in range(9)]))
    own = parts.manifest(spark, path).parts
    for p in (own[0], own[2]):  # the vectors of all parts, and the keys of parts whose ids lie elsewhere, are out of reach
        os.rename(f"{path}/keys/{p.name}", f"{path}/keys/_{p.name}")
    for p in own:
        os.rename(f"{path}/parts/{p.name}", f"{path}/parts/_{p.name}")
    assert parts.append(path, rows(spark, ["b77"])).rows == 28
    with pytest.raises(ValueError, match="b3"):
        parts.append(path, rows(spark, ["b3"]))


def test_what_is_refused_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/index"
    parts.create(spark, path, 8)
    parts.append(path, rows(spark, ["a", "b", "c"]))
    there = sorted(os.listdir(f"{path}/parts")), sorted(os.listdir(f"{path}/keys"))
    good = rows(spark, ["d"])
    bad = [rows(spark, ["b"]), rows(spark, ["x", "x"]), rows(spark, ["y"], 9), good.withColumn("tile_id", F.lit(None).cast("string")), good.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float")))]
    for more in bad:
        with pytest.raises(ValueError):
            parts.append(path, more)
        assert (sorted(os.listdir(f"{path}/parts")), sorted(os.listdir(f"{path}/keys"))) == there
    assert parts.manifest(spark, path).version == 1


def test_torn_writes_and_others_meanwhile(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    parts.create(spark, path, 8)
    parts.append(path, rows(spark, ["a"]))
    with open(f"{path}/manifest-00000002.json", "w") as file:  # a writer died halfway
        file.write(parts.Manifest(2, 8, ()).written()[:-9])
    rows(spark, ["ghost"]).write.parquet(f"{path}/parts/unlisted")
    assert parts.manifest(spark, path).version == 1 and parts.load(spark, path).count() == 1
    assert parts.append(path, rows(spark, ["b"])).version == 3
    described, meanwhile = parts._described, []

    def another(name, frame):
        out = described(name, frame)
        if not meanwhile:  # between the first look and the taking of a number, somebody else is done
            meanwhile.append(1)
            parts.append(path, rows(spark, ["c"]))
        return out

    monkeypatch.setattr(parts, "_described", another)
    assert parts.append(path, rows(spark, ["d"])).rows == 4
    meanwhile.clear()
    with pytest.raises(ValueError, match="'c'|already"):
        parts.append(path, rows(spark, ["c"]))
    monkeypatch.undo()
    assert {r.tile_id for r in parts.load(spark, path, verify=True).collect()} == {"a", "b", "c", "d"}
    part = parts.manifest(spark, path).parts[0]
    rows(spark, ["a"], seed=2).write.mode("overwrite").parquet(f"{path}/parts/{part.name}")
    with pytest.raises(ValueError, match="changed"):
        parts.load(spark, path, verify=True)
