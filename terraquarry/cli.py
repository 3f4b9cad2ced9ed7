"""Commands over tables on any storage that Spark reads: ``python -m terraquarry.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquarry.operators import detection, embedding, evaluation, index, pairing, suppression
from terraquarry.plans import workflows
from terraquarry.sources import tables
from terraquarry.sources.rasterfiles import write_rasters
from terraquarry.storage import stored


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="terraquarry", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *options: tuple) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=help_)
        for flags, more in options:
            made.add_argument(*flags, **more)
        made.add_argument("--format", choices=("table", "json"), default="table")
        return made

    text, number, whole, flag = {}, {"type": float}, {"type": int}, {"action": "store_true"}
    need = {"required": True}
    some_tiles = [(("--tile-id",), text), (("--scene-a",), text), (("--scene-b",), text)]
    compared = [(("--index",), need), (("--rasters",), need), *some_tiles, (("--no-clouds",), flag), (("--min-valid-ratio",), {"type": float, "default": 0.10}), (("--output-dir",), text)]
    command(
        "search", "search tiles by text", (("query",), text), (("--index",), need), (("--top-k",), {"type": int, "default": 5}), (("--modality",), {"choices": ("optical", "sar")}),
        (("--date-from",), text), (("--date-to",), text), (("--scene-id",), text), (("--bbox",), {"type": float, "nargs": 4}), (("--dimension",), {"type": int, "default": index.DIMENSION}),
    )
    command(
        "pair", "pairs of a tile, of two scenes, of a modality or all", (("--index",), need), *some_tiles, (("--modality",), text), (("--all",), flag), (("--target-scene",), text),
        (("--min-days",), {"type": float, "default": 0.0}), (("--max-days",), number),
    )
    command("change", "compare pairs", *compared, (("--save-map",), flag))
    command(
        "suppress", "compare pairs and suppress false alarms", *compared, (("-k", "--sensitivity-k"), {"type": float, "default": 3.0}), (("--min-threshold-offset",), {"type": float, "default": 0.0}),
        (("--min-neighbors",), {"type": int, "default": 2}), (("--min-region-area",), {"type": int, "default": 4}), (("--min-valid-pixels",), {"type": int, "default": 100}),
        (("--save-masks",), flag), (("--save-change-map",), flag),
    )
    command(
        "tile", "tile scene folders", (("--optical",), text), (("--radar",), text), (("--output-dir",), need), (("--tile-size",), {"type": int, "default": 256}), (("--stride",), whole),
        (("--boundary-strategy",), {"choices": ("shift", "truncate", "pad"), "default": "shift"}), (("--files",), flag),
    )
    command("index", "build or inspect an index, or search it by a tile", (("--embeddings",), text), (("--tiles",), text), (("--index",), need), (("--inspect",), flag), (("--search-tile",), text), (("--top-k",), {"type": int, "default": 5}), (("--dimension",), {"type": int, "default": index.DIMENSION}))
    command("manifest", "images and captions of a benchmark's table", (("--source-parquet",), need), (("--output-dir",), need))
    command("evaluate", "retrieval measures on random vectors", (("--manifest",), need), (("--max-samples",), whole), (("--dimension",), {"type": int, "default": 512}))
    command("weights", "whether a model's files are staged", (("--output-dir",), need))
    return out


def _pairs(tiles: DataFrame, args: argparse.Namespace) -> DataFrame:
    if args.tile_id:
        extra = {k: getattr(args, v) for k, v in (("min_days", "min_days"), ("max_days", "max_days"), ("target_scene", "target_scene")) if hasattr(args, v)}
        return pairing.pair_for_tile(tiles, args.tile_id, **extra)
    if args.scene_a or args.scene_b:
        if not (args.scene_a and args.scene_b):
            raise ValueError("give both scenes")
        return pairing.pairs_of_scenes(tiles, args.scene_a, args.scene_b)
    return pairing.in_order(pairing.all_tile_pairs(tiles, getattr(args, "modality", None)))


def _compared(spark: SparkSession, args: argparse.Namespace, limits: suppression.SuppressionConfig) -> tuple[dict[str, DataFrame], DataFrame]:
    tiles, rasters = spark.read.parquet(args.index), spark.read.parquet(args.rasters)
    config = detection.ChangeConfig(mask_clouds=not args.no_clouds, min_valid_ratio=args.min_valid_ratio)
    return workflows.compare(tiles, rasters, _pairs(tiles, args), config, limits), workflows.headers_and_pixels(rasters)[0]


def _saved(rows: DataFrame, path: str | None) -> None:
    if not path:
        raise ValueError("--output-dir is needed to save maps")
    write_rasters(rows, path, overwrite=True)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The rows that a command shows."""
    if args.command == "search":
        engine = index.TextSearch.open(spark, args.index, embedding.HashEmbedder(args.dimension), args.dimension)
        return engine.search(args.query, args.top_k, args.modality, args.date_from, args.date_to, args.scene_id, args.bbox)
    if args.command == "pair":
        return _pairs(spark.read.parquet(args.index), args)
    if args.command == "change":
        found, headers = _compared(spark, args, suppression.SuppressionConfig())
        if args.save_map:
            _saved(workflows.change_maps(found["changes"], headers), args.output_dir)
        return found["changes"].drop("magnitude")
    if args.command == "suppress":
        limits = suppression.SuppressionConfig(args.sensitivity_k, args.min_threshold_offset, args.min_neighbors, args.min_region_area, args.min_valid_pixels)
        found, headers = _compared(spark, args, limits)
        if args.save_masks:
            _saved(workflows.confirmed_maps(found["changes"], found["candidates"], headers), args.output_dir)
        if args.save_change_map:
            _saved(workflows.change_maps(found["changes"], headers), args.output_dir)
        return found["suppressed"]
    if args.command == "tile":
        made = None
        for path, make in ((args.optical, workflows.tile_optical), (args.radar, workflows.tile_radar)):
            if path:
                tiles, rasters = make(spark, path, args.tile_size, args.stride, args.boundary_strategy)
                rasters = stored(rasters, "rasters")
                workflows.write_tiles(tiles, rasters, f"{args.output_dir}/{make.__name__}")
                if args.files:
                    workflows.write_tile_files(tiles, rasters, f"{args.output_dir}/{make.__name__}/files")
                sized = rasters.groupBy("tile_id").agg(F.sum("n_bytes").alias("n_bytes"))
                part = tiles.select("modality", "scene_id", "tile_id").join(sized, "tile_id")
                made = part if made is None else made.unionByName(part)
        if made is None:
            raise ValueError("give --optical or --radar")
        return workflows.tiling.tiling_summary(made, "n_bytes")
    if args.command == "index":
        if args.embeddings:
            tiles = spark.read.parquet(args.tiles)
            index.save(workflows.index_of_folders(spark, args.embeddings, tiles, args.dimension), args.index, args.dimension)
        if args.search_tile:
            return index.TextSearch.open(spark, args.index, dimension=args.dimension).like_tile(args.search_tile, args.top_k)
        return index.group_counts(index.load(spark, args.index, args.dimension))
    if args.command == "manifest":
        images, captions = evaluation.items_of(spark.read.parquet(args.source_parquet))
        images.write.mode("error").parquet(f"{args.output_dir}/images")
        captions.write.mode("error").parquet(f"{args.output_dir}/captions")
        return evaluation.manifest_summary(images, captions)
    if args.command == "evaluate":
        images, captions = (spark.read.parquet(f"{args.manifest}/{n}") for n in ("images", "captions"))
        if args.max_samples:
            images = evaluation.first_samples(images, args.max_samples, F.col("image_id"))
            captions = captions.join(images.select("image_id"), "image_id", "left_semi")
        return evaluation.synthetic_benchmark(images, captions, args.dimension)
    return tables.staged_model(spark, args.output_dir)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("terraquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        rows = run(spark, args)
        if args.format == "json":
            for line in rows.toJSON().toLocalIterator():
                print(json.dumps(json.loads(line)))
        else:
            rows.show(1000, truncate=False)
    except (ValueError, TypeError, KeyError, FileNotFoundError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
