"""A tile index that grows by parts: an append reads and checks the new rows and the keys there are, and becomes visible at once or never.

An index is a folder: ``parts/NAME`` (vectors and metadata), ``keys/NAME`` (tile_id alone) and
manifests, numbered. A manifest lists the parts with their rows, digests and spans of ids, and
carries its own digest: readers take the latest whole one, so a part that no manifest names and a
manifest that was torn are not seen. Numbers are taken by creating the file where there is none;
who comes second checks its keys against what the first has added, and takes the next number.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquarry.operators import index

_TRIES = 20


@dataclass(frozen=True)
class Part:
    """A part: its name, rows, digest (of ids and vectors, in any order) and least and greatest id."""

    name: str
    rows: int
    digest: str
    least: str | None
    greatest: str | None


@dataclass(frozen=True)
class Manifest:
    """What an index holds at a version; version 0 is an index without parts."""

    version: int
    dimension: int
    parts: tuple[Part, ...]

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)

    def written(self) -> str:
        body = json.dumps({"version": self.version, "dimension": self.dimension, "parts": [asdict(p) for p in self.parts]}, sort_keys=True)
        return json.dumps({"body": body, "sha256": hashlib.sha256(body.encode()).hexdigest()})

    @classmethod
    def read(cls, text: str) -> Manifest | None:
        """A manifest from its text, or None if it isn't whole."""
        try:
            outer = json.loads(text)
            body = outer["body"]
            if hashlib.sha256(body.encode()).hexdigest() != outer["sha256"]:
                return None
            found = json.loads(body)
            return cls(found["version"], found["dimension"], tuple(Part(**p) for p in found["parts"]))
        except (ValueError, KeyError, TypeError):
            return None


class _Folder:
    """The index's folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        """The numbers of the manifests there are, whole or not, latest first."""
        if not self.system.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(self.root)]
        return sorted((int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:17].isdigit()), reverse=True)

    def text(self, version: int) -> str:
        stream = self.system.open(self.at(_file(version)))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def take(self, version: int, text: str) -> bool:
        """Create a version's file with a text; False if somebody has."""
        try:
            stream = self.system.create(self.at(_file(version)), False)
        except Exception as error:  # what the file system throws differs by system
            if self.system.exists(self.at(_file(version))):
                return False
            raise error
        stream.write(bytearray(text.encode()))
        stream.close()
        return True


def _file(version: int) -> str:
    return f"manifest-{version:08d}.json"


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The latest whole manifest of an index."""
    folder = _Folder(spark, path)
    for version in folder.versions():
        found = Manifest.read(folder.text(version))
        if found is not None:
            return found
    raise FileNotFoundError(f"no index at {path}")


def create(spark: SparkSession, path: str, dimension: int = index.DIMENSION) -> Manifest:
    """A new index without parts; one that is there is an error."""
    if dimension <= 0:
        raise ValueError("the dimension must be positive")
    empty = Manifest(0, dimension, ())
    folder = _Folder(spark, path)
    if folder.versions() or not folder.take(0, empty.written()):
        raise FileExistsError(f"there is an index at {path}")
    return empty


def _digest() -> list:
    """Rows, an order-free digest of ids and vectors, and the span of ids."""
    h = F.xxhash64("tile_id", "embedding")
    return [F.count("*").alias("rows"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_003).cast("long")).alias("s"), F.min("tile_id").alias("least"), F.max("tile_id").alias("greatest")]


def _described(name: str, rows: DataFrame) -> Part:
    r = rows.agg(*_digest()).first()
    return Part(name, r["rows"], f"{r['x'] or 0}:{r['s'] or 0}", r["least"], r["greatest"])


def _refuse_repeats(spark: SparkSession, path: str, new: Part, others: tuple[Part, ...]) -> None:
    """A ValueError if an id of a new part is in another: parts whose ids lie elsewhere are not read, of the rest the keys alone."""
    meet = [p.name for p in others if p.rows and new.rows and p.least <= new.greatest and new.least <= p.greatest]
    if meet:
        keys = spark.read.schema("tile_id string").parquet(*(f"{path}/keys/{n}" for n in meet))
        twice = keys.join(spark.read.schema("tile_id string").parquet(f"{path}/keys/{new.name}"), "tile_id", "left_semi").first()
        if twice is not None:
            raise ValueError(f"the index has a tile {twice.tile_id!r} already")


def append(path: str, more: DataFrame) -> Manifest:
    """Add rows (the columns of an index) as one part; rows that are no unit vectors of the dimension, or whose ids are there, are a ValueError and add nothing."""
    spark, path = more.sparkSession, path.rstrip("/")
    folder, seen = _Folder(spark, path), manifest(spark, path)
    name = uuid.uuid4().hex
    try:
        more.write.parquet(f"{path}/parts/{name}")
        rows = spark.read.schema(more.schema).parquet(f"{path}/parts/{name}")
        index.checked(rows, seen.dimension)
        rows.select("tile_id").write.parquet(f"{path}/keys/{name}")
        part, known = _described(name, rows), ()
        for _ in range(_TRIES):
            fresh = tuple(p for p in seen.parts if p not in known)
            _refuse_repeats(spark, path, part, fresh)
            known = seen.parts
            number = max(folder.versions()) + 1
            out = Manifest(number, seen.dimension, (*seen.parts, part))
            latest = manifest(spark, path)
            if latest == seen and folder.take(number, out.written()):
                return out
            seen = manifest(spark, path)
        raise RuntimeError(f"{_TRIES} others have written to {path} meanwhile")
    except (ValueError, RuntimeError, PySparkException):
        for kind in ("parts", "keys"):
            folder.system.delete(folder.at(kind, name), True)
        raise


def load(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The rows of an index's parts; with ``verify``, parts that are not as they were written are a ValueError."""
    found, path = manifest(spark, path), path.rstrip("/")
    if not found.parts:
        raise ValueError(f"the index at {path} has no parts")
    frames = {p: f"{path}/parts/{p.name}" for p in found.parts}
    if verify:
        for part, place in frames.items():
            now = _described(part.name, spark.read.parquet(place))
            if now != part:
                raise ValueError(f"part {part.name} has changed: {part.rows} rows were written, {now.rows} are there")
    return spark.read.parquet(*frames.values())


def compact(spark: SparkSession, path: str) -> Manifest:
    """All parts as one; readers of the old ones are not disturbed, since their files stay (``vacuum``)."""
    seen, path = manifest(spark, path), path.rstrip("/")
    folder, name = _Folder(spark, path), uuid.uuid4().hex
    rows = load(spark, path)
    rows.write.parquet(f"{path}/parts/{name}")
    whole = spark.read.parquet(f"{path}/parts/{name}")
    whole.select("tile_id").write.parquet(f"{path}/keys/{name}")
    out = Manifest(max(folder.versions()) + 1, seen.dimension, (_described(name, whole),))
    if out.rows != seen.rows or manifest(spark, path) != seen or not folder.take(out.version, out.written()):
        raise RuntimeError(f"{path} has changed meanwhile")
    return out


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of parts that the latest manifest doesn't name; their names."""
    folder, keep = _Folder(spark, path), {p.name for p in manifest(spark, path).parts}
    gone = []
    for kind in ("parts", "keys"):
        if folder.system.exists(folder.at(kind)):
            for status in folder.system.listStatus(folder.at(kind)):
                if status.getPath().getName() not in keep:
                    folder.system.delete(status.getPath(), True)
                    gone.append(f"{kind}/{status.getPath().getName()}")
    return sorted(gone)
