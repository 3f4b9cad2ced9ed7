"""Temporal pairing of observations of the same place.

The keyed functions (``nearest_in_time``, ``all_pairs``, ``scene_pairs``, ``scene_envelope``)
work on any columns. The others take a tile index: tile_id, scene_id, modality,
acquisition_datetime_utc (ISO text), row_idx, col_idx, bounds_wgs84, bounds_projected, crs and
tile_directory; (scene_id, row_idx, col_idx) is a key of it, as ``index_violations`` checks.
"""

from __future__ import annotations

from numbers import Real

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquarry.functions.scalars import box_iou, parse_iso_datetime
from terraquarry.operators.stats import violations
from terraquarry.storage import stored

MICROS = 86_400_000_000
#: Modalities, alignment types and methods of spatial correspondence.
MODALITIES = ("optical", "sar")
ALIGNED, UNALIGNED_RADAR, UNALIGNED_METADATA = "native_pixel_aligned", "unaligned_radar_grid", "unaligned_metadata_mismatch"
HEADER_MISMATCHES = ("unaligned_raster_dimension_mismatch", "unaligned_crs_mismatch", "unaligned_transform_mismatch", "unaligned_resolution_mismatch", "unaligned_bounds_mismatch")
EXACT, TOPOLOGICAL = "grid_index_exact", "grid_index_topological"
#: Header fields of a tile's reference band, in the order in which they are compared.
HEADER = ("shape", "header_crs", "affine", "resolution", "header_bounds")
GRID = ["modality", "row_idx", "col_idx"]


def _check_days(min_days: float, max_days: float | None) -> None:
    for name, value in (("min_days", min_days), ("max_days", max_days)):
        if value is None and name == "max_days":
            continue
        if isinstance(value, bool) or not isinstance(value, Real):
            raise TypeError(f"{name} must be a number, not {type(value).__name__}")
        if value < 0:
            raise ValueError(f"{name} can't be negative")
    if max_days is not None and min_days > max_days:
        raise ValueError("min_days exceeds max_days")


# ---------------------------------------------------------------- on any keys


def _beside(events: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """``events`` (keys, v, kind, point) with ``earlier`` and ``later``: the last point of the key before each row by (v, kind), and the first after it.

    Rows are dealt by range of (keys, v, kind), so that a key of any size lies in as many
    ranges as its rows fill. Within a range each way is a frame that only grows. Beyond it, a
    range borrows the last (and first) point of its key's ranges before (and after) it: one row
    a key and range. The dealt rows are written once, with the number of their range.
    """
    count = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(events.repartitionByRange(count, *keys, "v", "kind").withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range", *keys)
    up, down = own.orderBy("v", "kind"), own.orderBy(F.col("v").desc(), F.col("kind").desc())
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("_earlier", F.last("point", ignorenulls=True).over(before(up))).withColumn("_later", F.last("point", ignorenulls=True).over(before(down)))
    ends = dealt.groupBy("range", *keys).agg(F.min("point").alias("first"), F.max("point").alias("last"))
    of_key = Window.partitionBy(*keys)
    lent = ends.withColumn("_before", F.last("last", ignorenulls=True).over(before(of_key.orderBy("range")))).withColumn("_after", F.last("first", ignorenulls=True).over(before(of_key.orderBy(F.col("range").desc()))))
    joined = near.join(lent.select("range", *keys, "_before", "_after"), ["range", *keys])
    return joined.select(*events.columns, F.coalesce("_earlier", "_before").alias("earlier"), F.coalesce("_later", "_after").alias("later"))


def nearest_in_time(tiles: DataFrame, keys: list[str], min_days: float = 0.0, max_days: float | None = None, target_scene: str | None = None, ranges: int | None = None) -> DataFrame:
    """Each tile with the tile of its key nearest in time at another instant: the later one of two as near, then the smaller scene.

    ``tiles`` has scene_id, acquired (timestamp) and the keys; a scene has one tile of a key.
    Tiles collapse to instants first; ``_beside`` finds each one's neighbours, however many
    instants a key has. With ``min_days``, an instant asks at its time less and plus so many
    days. With ``target_scene``, only that scene's tiles are partners. Tiles without a partner
    (or with null keys or times) have no row. ``ranges`` is the number of tasks (default: the
    shuffle partitions).
    """
    _check_days(min_days, max_days)
    at = tiles.where(F.col("acquired").isNotNull()).select(*keys, "scene_id", "acquired").dropna(subset=keys)
    at = at.withColumn("us", F.unix_micros(F.col("acquired").cast("timestamp")))
    near = max(1, int(min_days * MICROS))
    partners = at if target_scene is None else at.where(F.col("scene_id") == target_scene)
    mine = at.select(*keys, "us", F.lit(None).cast(at.schema["scene_id"].dataType).alias("partner")).unionByName(partners.select(*keys, "us", F.col("scene_id").alias("partner")))
    instants = mine.groupBy(*keys, "us").agg(F.min("partner").alias("partner"))
    point = F.when(F.col("partner").isNotNull(), F.struct(F.col("us").alias("us"), F.col("partner").alias("scene")))
    if near == 1:  # an instant is its own question: what stands beside it
        best = _beside(instants.select(*keys, "us", F.col("us").alias("v"), F.lit(1).alias("kind"), point.alias("point")), keys, ranges)
    else:
        row = lambda v, kind, p: F.struct(v.alias("v"), F.lit(kind).alias("kind"), p.alias("point"))
        none = F.lit(None).cast(instants.select(point.alias("p")).schema["p"].dataType)
        asked = instants.select(*keys, "us", F.inline(F.array(row(F.col("us") + near, 0, none), row(F.col("us"), 1, point), row(F.col("us") - near, 2, none))))
        beside = _beside(asked, keys, ranges)
        best = beside.groupBy(*keys, "us").agg(F.max(F.when(F.col("kind") == 2, F.col("earlier"))).alias("earlier"), F.max(F.when(F.col("kind") == 0, F.col("later"))).alias("later"))
    later, earlier = F.col("later.us") - F.col("us"), F.col("us") - F.col("earlier.us")
    take_later = F.col("earlier").isNull() | F.coalesce(later <= earlier, F.lit(False))
    best = best.withColumn("best", F.when(take_later, F.col("later")).otherwise(F.col("earlier"))).where(F.col("best").isNotNull())
    if max_days is not None:
        best = best.where(F.abs(F.col("best.us") - F.col("us")) <= int(max_days * MICROS))
    found = at.join(best.select(*keys, "us", "best"), [*keys, "us"])
    if target_scene is not None:
        found = found.where(F.col("scene_id") != target_scene)
    return found.select(*keys, "scene_id", F.col("best.scene").alias("partner_id"), ((F.col("best.us") - F.col("us")) / 1e6).alias("delta_seconds"))


def all_pairs(tiles: DataFrame, keys: list[str], min_days: float = 0.0, max_days: float | None = None) -> DataFrame:
    """All earlier-later pairs within a key: (keys, reference_id, comparison_id, delta_days). The output is the pairs themselves.

    With ``max_days``, the join is on spans of that length as well, so that a key's tiles meet
    only those of their own and the next span.
    """
    _check_days(min_days, max_days)
    a = tiles.select(*keys, F.col("scene_id").alias("reference_id"), F.col("acquired").alias("t0"))
    b = tiles.select(*keys, F.col("scene_id").alias("comparison_id"), F.col("acquired").alias("t1"))
    on = list(keys)
    if max_days:
        span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(max(1, int(max_days * MICROS))))
        a, b = a.withColumn("span", span("t0")), b.withColumn("span", F.explode(F.array(span("t1"), span("t1") - 1)))
        on.append("span")
    days = F.timestamp_diff("SECOND", F.col("t0"), F.col("t1")) / 86400.0
    pairs = a.join(b, on).where(F.col("t0") < F.col("t1")).withColumn("delta_days", days).where(F.col("delta_days") >= min_days)
    if max_days is not None:
        pairs = pairs.where(F.col("delta_days") <= max_days)
    return pairs.select(*keys, "reference_id", "comparison_id", "delta_days")


def scene_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of both scenes, the tile counts of each; keys of one alone have no row. Counts precede the join."""
    count = lambda side, name: side.groupBy(*keys).agg(F.count("*").alias(name))
    return count(left, "n_left").join(count(right, "n_right"), keys)


def scene_envelope(tiles: DataFrame, scene: str, x: str, y: str) -> DataFrame:
    """The bounds of each scene's tiles and their number."""
    return tiles.groupBy(scene).agg(
        F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"), F.count("*").alias("n_tiles")
    )


# ---------------------------------------------------------------- tile index


def index_violations(tiles: DataFrame) -> DataFrame:
    """Rows of a tile index that can't be paired: tile_id, scene_id and the names of the broken rules, in order."""
    filled = lambda c: F.length(F.trim(F.col(c))) > 0
    bounds = F.col("bounds_wgs84")
    rules = {
        "tile_id": filled("tile_id"),
        "scene_id": filled("scene_id"),
        "modality": F.col("modality").isin(*MODALITIES),
        "acquisition_datetime_utc": parse_iso_datetime(F.col("acquisition_datetime_utc")).isNotNull(),
        "grid_index": F.col("row_idx").isNotNull() & F.col("col_idx").isNotNull(),
        "bounds_wgs84": F.size(bounds) == 4,
        "inverted_bounds": (F.get(bounds, F.lit(0)) <= F.get(bounds, F.lit(2))) & (F.get(bounds, F.lit(1)) <= F.get(bounds, F.lit(3))),
        "tile_directory": filled("tile_directory"),
        "duplicate_tile_id": F.col("_ids") == 1,
        "duplicate_grid_index": F.col("_places") == 1,
    }
    counted = tiles.withColumn("_ids", F.count("*").over(Window.partitionBy("tile_id")))
    counted = counted.withColumn("_places", F.count("*").over(Window.partitionBy("scene_id", "row_idx", "col_idx")))
    return violations(counted, ["tile_id", "scene_id"], rules)


def scenes_of(tiles: DataFrame) -> DataFrame:
    """A row per scene: modality, time and crs of its first tile by id, the envelope, the tiles and their grid cells' number."""
    first = lambda c: F.min_by(c, "tile_id").alias(c)
    side = lambda f, i, name: f(F.get("bounds_wgs84", F.lit(i))).alias(name)
    return tiles.groupBy("scene_id").agg(
        first("modality"), first("acquisition_datetime_utc"), first("crs"), side(F.min, 0, "west"), side(F.min, 1, "south"), side(F.max, 2, "east"), side(F.max, 3, "north"),
        F.count("*").alias("tile_count"), F.count_distinct("row_idx", "col_idx").alias("grid_cells"),
    ).withColumn("acquired", parse_iso_datetime(F.col("acquisition_datetime_utc")))


def incompatibility(a: dict[str, Column], b: dict[str, Column], shared_cells: Column) -> Column:
    """Why two scenes can't be paired, or null: the first that holds. Instants are compared, not their spelling."""
    overlap = (F.greatest(a["west"], b["west"]) < F.least(a["east"], b["east"])) & (F.greatest(a["south"], b["south"]) < F.least(a["north"], b["north"]))
    return (
        F.when(a["scene_id"] == b["scene_id"], "same scene")
        .when(a["modality"] != b["modality"], "modality mismatch")
        .when(a["acquired"] == b["acquired"], "identical acquisition times")
        .when(~F.coalesce(overlap, F.lit(False)), "disjoint footprints")
        .when(F.coalesce(shared_cells, F.lit(0)) == 0, "no shared grid index")
    )


def scene_compatibility(tiles: DataFrame, scene_a: str, scene_b: str) -> DataFrame:
    """One row: scene_a, scene_b, shared_cells, reason (null where they can be paired). Of an unknown scene, no row."""
    cells = tiles.where(F.col("scene_id").isin(scene_a, scene_b)).groupBy("row_idx", "col_idx").agg(F.count_distinct("scene_id").alias("n"))
    shared = cells.agg(F.count_if(F.col("n") == 2).alias("shared_cells"))  # one row
    found = scenes_of(tiles.where(F.col("scene_id").isin(scene_a, scene_b)))
    side = lambda scene, prefix: found.where(F.col("scene_id") == scene).select(*(F.col(c).alias(f"{prefix}{c}") for c in found.columns))
    both = side(scene_a, "a_").crossJoin(F.broadcast(side(scene_b, "b_"))).crossJoin(F.broadcast(shared))  # one row each
    columns = lambda prefix: {c: F.col(f"{prefix}{c}") for c in found.columns}
    return both.select(F.col("a_scene_id").alias("scene_a"), F.col("b_scene_id").alias("scene_b"), "shared_cells", incompatibility(columns("a_"), columns("b_"), F.col("shared_cells")).alias("reason"))


def optical_alignment(ref: dict[str, Column], comp: dict[str, Column], headers: bool = False) -> Column:
    """How two optical tiles' pixel grids relate. With ``headers`` (both have HEADER), the first that differs; else metadata decide."""
    metadata = (ref["crs"] != "") & (ref["crs"] == comp["crs"]) & (F.size(ref["bounds_projected"]) > 0) & (ref["bounds_projected"] == comp["bounds_projected"])
    by_metadata = F.when(F.coalesce(metadata, F.lit(False)), ALIGNED).otherwise(UNALIGNED_METADATA)
    if not headers:
        return by_metadata
    found = F.lit(ALIGNED)
    for field, name in reversed(list(zip(HEADER, HEADER_MISMATCHES, strict=True))):
        found = F.when(~ref[field].eqNullSafe(comp[field]), name).otherwise(found)
    return F.when(ref["shape"].isNotNull() & comp["shape"].isNotNull(), found).otherwise(by_metadata)


def _sides(tiles: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    named = tiles.withColumn("acquired", parse_iso_datetime(F.col("acquisition_datetime_utc")))
    rest = [c for c in named.columns if c not in GRID]
    side = lambda prefix: named.select(*GRID, *(F.col(c).alias(f"{prefix}{c}") for c in rest))
    return side("ref_"), side("comp_"), rest


def _described(joined: DataFrame, rest: list[str]) -> DataFrame:
    """Pairs from rows with ref_ and comp_ columns, the earlier one as ref_."""
    ref, comp = ({c: F.col(f"{p}{c}") for c in rest} for p in ("ref_", "comp_"))
    box = lambda t: [F.get(t["bounds_wgs84"], F.lit(i)) for i in range(4)]
    radar = F.col("modality") != "optical"
    kind = F.when(radar, UNALIGNED_RADAR).otherwise(optical_alignment(ref, comp, set(HEADER) <= set(rest)))
    staged = joined.withColumn("_kind", kind).withColumn("_aligned", F.col("_kind") == ALIGNED)
    same = F.col("_aligned") & F.coalesce(ref["bounds_wgs84"] == comp["bounds_wgs84"], F.lit(False))
    iou = F.when(same, 1.0).otherwise(F.round(box_iou(box(ref), box(comp)), 6))
    seconds = (F.unix_micros(comp["acquired"]) - F.unix_micros(ref["acquired"])) / 1e6
    return staged.select(
        F.concat_ws("__", F.lit("pair"), ref["tile_id"], comp["tile_id"]).alias("pair_id"), "modality",
        *(t[c].alias(f"{name}_{c}") for c in ("tile_id", "scene_id") for name, t in (("reference", ref), ("comparison", comp))),
        ref["acquisition_datetime_utc"].alias("reference_datetime_utc"), comp["acquisition_datetime_utc"].alias("comparison_datetime_utc"), (seconds / 86400.0).alias("temporal_delta_days"),
        F.struct(F.when(F.col("_aligned"), EXACT).otherwise(TOPOLOGICAL).alias("method"), "row_idx", "col_idx", iou.alias("spatial_iou_wgs84"), ref["bounds_wgs84"].alias("bounds_wgs84")).alias("spatial"),
        F.struct(F.col("_aligned").alias("is_pixel_aligned"), F.col("_kind").alias("alignment_type"), F.when(~radar, ref["crs"]).alias("crs"), F.array(F.lit(256), F.lit(256)).alias("pixel_dimensions")).alias("alignment"),
        ref["tile_directory"].alias("reference_tile_dir"), comp["tile_directory"].alias("comparison_tile_dir"),
    )


def pair_rows(tiles: DataFrame, links: DataFrame) -> DataFrame:
    """Described pairs of linked tiles (tile_a, tile_b), the earlier as the reference.

    Links across modalities, scenes' own tiles, grid cells or at one instant make no pair.
    """
    ref, comp, rest = _sides(tiles)
    both = links.select(F.col("tile_a").alias("ref_tile_id"), F.col("tile_b").alias("comp_tile_id"))
    both = both.unionByName(both.select(F.col("comp_tile_id").alias("ref_tile_id"), F.col("ref_tile_id").alias("comp_tile_id"))).distinct()
    joined = both.join(ref, "ref_tile_id").join(comp, ["comp_tile_id", *GRID])
    return _described(joined.where((F.col("ref_scene_id") != F.col("comp_scene_id")) & (F.col("ref_acquired") < F.col("comp_acquired"))), rest)


def counterparts(tiles: DataFrame, tile_id: str | None = None, min_days: float = 0.0, max_days: float | None = None, target_scene: str | None = None) -> DataFrame:
    """All counterparts of a tile, or of every tile: query_tile_id, choice (1 is the nearest; the later, then the smaller scene of equals) and the pair.

    Scenes' footprints are not compared. An unknown ``tile_id`` or ``target_scene`` is a KeyError.
    """
    _check_days(min_days, max_days)
    for name, value, column in (("tile_id", tile_id, "tile_id"), ("target_scene", target_scene, "scene_id")):
        if value is not None:
            if not isinstance(value, str):
                raise TypeError(f"{name} must be a string, not {type(value).__name__}")
            if tiles.where(F.col(column) == value).isEmpty():
                raise KeyError(value)
    ref, comp, rest = _sides(tiles)
    query = ref if tile_id is None else ref.where(F.col("ref_tile_id") == tile_id)
    other = comp if target_scene is None else comp.where(F.col("comp_scene_id") == target_scene)
    met = query.join(other, GRID).where((F.col("ref_scene_id") != F.col("comp_scene_id")) & (F.col("ref_acquired") != F.col("comp_acquired")))
    away = F.unix_micros("comp_acquired") - F.unix_micros("ref_acquired")
    met = met.withColumn("_away", away).where(F.abs("_away") >= int(min_days * MICROS))
    if max_days is not None:
        met = met.where(F.abs("_away") <= int(max_days * MICROS))
    choice = Window.partitionBy("ref_tile_id").orderBy(F.abs("_away"), F.col("_away") < 0, "comp_scene_id")
    met = met.withColumn("choice", F.row_number().over(choice)).withColumn("query_tile_id", F.col("ref_tile_id"))
    later = F.col("_away") > 0
    turned = met.select(*GRID, "query_tile_id", "choice", *(F.when(later, F.col(f"{p}{c}")).otherwise(F.col(f"{q}{c}")).alias(f"{p}{c}") for p, q in (("ref_", "comp_"), ("comp_", "ref_")) for c in rest))
    pairs = _described(turned, rest)
    keys = turned.select("query_tile_id", "choice", F.concat_ws("__", F.lit("pair"), "ref_tile_id", "comp_tile_id").alias("pair_id"))
    return keys.join(pairs.dropDuplicates(["pair_id"]), "pair_id")


def pair_for_tile(tiles: DataFrame, tile_id: str, min_days: float = 0.0, max_days: float | None = None, target_scene: str | None = None) -> DataFrame:
    """The pair of a tile with its nearest counterpart, or no row."""
    return counterparts(tiles, tile_id, min_days, max_days, target_scene).where("choice = 1").drop("choice", "query_tile_id")


def pairs_of_scenes(tiles: DataFrame, scene_a: str, scene_b: str) -> DataFrame:
    """All pairs of two scenes, in order; none where their footprints are disjoint. Other incompatible scenes are a ValueError."""
    for scene in (scene_a, scene_b):
        if not isinstance(scene, str):
            raise TypeError(f"a scene id must be a string, not {type(scene).__name__}")
    if scene_a == scene_b:
        raise ValueError(f"can't pair scene {scene_a!r} with itself")
    row = scene_compatibility(tiles, scene_a, scene_b).first()
    if row is None:
        raise KeyError(f"{scene_a!r} or {scene_b!r} is not in the index")
    if row.reason and row.reason != "disjoint footprints":
        raise ValueError(f"scenes {scene_a!r} and {scene_b!r} can't be paired: {row.reason}")
    own = tiles.where(F.col("scene_id").isin(scene_a, scene_b)) if not row.reason else tiles.where("1 = 0")
    ref, comp, rest = _sides(own)
    joined = ref.join(comp, GRID).where((F.col("ref_scene_id") != F.col("comp_scene_id")) & (F.col("ref_acquired") < F.col("comp_acquired")))
    return _described(joined, rest).orderBy("spatial.row_idx", "spatial.col_idx", "pair_id")


def all_tile_pairs(tiles: DataFrame, modality: str | None = None) -> DataFrame:
    """All pairs of tiles of compatible scenes, unordered (see ``in_order``). The output is the pairs themselves.

    Scenes that share a grid cell meet in the join of tiles; their footprints are joined to them
    by scene, so that no scene meets all others.
    """
    if modality is not None:
        if not isinstance(modality, str):
            raise TypeError(f"modality must be a string, not {type(modality).__name__}")
        if modality.strip().lower() not in MODALITIES:
            raise ValueError(f"unsupported modality {modality!r}")
        tiles = tiles.where(F.col("modality") == modality.strip().lower())
    ref, comp, rest = _sides(tiles)
    joined = ref.join(comp, GRID).where((F.col("ref_scene_id") != F.col("comp_scene_id")) & (F.col("ref_acquired") < F.col("comp_acquired")))
    shape = scenes_of(tiles).select("scene_id", F.struct("west", "south", "east", "north", "acquired").alias("s"))
    for p in ("ref_", "comp_"):
        joined = joined.join(shape.select(F.col("scene_id").alias(f"{p}scene_id"), F.col("s").alias(f"{p}shape_")), f"{p}scene_id")
    a, b = F.col("ref_shape_"), F.col("comp_shape_")
    overlap = (F.greatest(a["west"], b["west"]) < F.least(a["east"], b["east"])) & (F.greatest(a["south"], b["south"]) < F.least(a["north"], b["north"]))
    return _described(joined.where(overlap & (a["acquired"] != b["acquired"])), rest)


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs in their total order."""
    return pairs.orderBy("modality", "reference_scene_id", "comparison_scene_id", "spatial.row_idx", "spatial.col_idx", "pair_id")


def totals(tiles: DataFrame) -> DataFrame:
    """One row: total_tiles, total_scenes."""
    return tiles.agg(F.count("*").alias("total_tiles"), F.count_distinct("scene_id").alias("total_scenes"))
