"""Evaluation of retrieval: a manifest of images and captions, three tasks, fourteen measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquarry.functions.scalars import category_of
from terraquarry.operators import search

#: How long the lists are that the two graded tasks look at.
CATEGORY_DEPTH, CLASS_DEPTH = 20, 50


def items_of(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and captions of a benchmark's table (filename, image (binary or a struct with bytes), captions).

    Images: image_id, relative_path, category, sha256, item_pos. Captions: caption_id, image_id, text.
    """
    data = F.col("image") if split.schema["image"].dataType.simpleString() == "binary" else F.col("image.bytes")
    named = split.select(F.element_at(F.split("filename", "/"), -1).alias("image_id"), data.alias("data"), "captions")
    images = named.select("image_id", F.concat(F.lit("images/"), "image_id").alias("relative_path"), category_of(F.col("image_id")).alias("category"), F.sha2("data", 256).alias("sha256"))
    captions = named.select("image_id", F.posexplode("captions").alias("at", "text"))
    return images, captions.select(F.format_string("%s_cap_%d", "image_id", "at").alias("caption_id"), "image_id", F.trim("text").alias("text"))


def manifest_summary(images: DataFrame, captions: DataFrame) -> DataFrame:
    """One row: image_count, caption_count, category_count, categories (in order; of a benchmark's, a bounded list)."""
    some = images.agg(F.count("*").alias("image_count"), F.count_distinct("category").alias("category_count"), F.sort_array(F.collect_set("category")).alias("categories"))
    return some.crossJoin(F.broadcast(captions.agg(F.count("*").alias("caption_count"))))  # one row each


def ground_truth(images: DataFrame, captions: DataFrame) -> dict[str, DataFrame]:
    """What is relevant: instance (query_id, image_id), category (query_id, category, n_rel), class (query_id, category, n_rel).

    Members of a category are a join on it, not lists: a list for each caption would grow with the
    square of a category. In ``class`` an image isn't relevant to itself.
    """
    sizes = images.groupBy("category").agg(F.count("*").alias("n"))
    own = captions.join(images.select("image_id", "category"), "image_id").join(sizes, "category")
    return {
        "instance": captions.select(F.col("caption_id").alias("query_id"), "image_id"),
        "category": own.select(F.col("caption_id").alias("query_id"), "category", F.col("n").alias("n_rel")),
        "class": images.join(sizes, "category").select(F.col("image_id").alias("query_id"), "category", (F.col("n") - 1).alias("n_rel")),
    }


def overlap(files: DataFrame, images: DataFrame) -> DataFrame:
    """One row: n_files, n_items, n_both, complete, of the distinct names of files (name) and items (image_id)."""
    both = files.select(F.col("name"), F.lit(1).alias("f"), F.lit(0).alias("i")).unionByName(images.select(F.col("image_id").alias("name"), F.lit(0).alias("f"), F.lit(1).alias("i")))
    named = both.groupBy("name").agg(F.max("f").alias("f"), F.max("i").alias("i"))
    return named.agg(F.sum("f").alias("n_files"), F.sum("i").alias("n_items"), F.sum(F.col("f") * F.col("i")).alias("n_both"), F.bool_and(F.col("f") == F.col("i")).alias("complete"))


def _measures(ranked: DataFrame, totals: DataFrame, depth: int, recall: tuple[int, ...] = (), precision: tuple[int, ...] = (), ndcg: bool = False) -> DataFrame:
    """Means over queries: recall and precision at some ranks, mAP and nDCG at the depth. (query_id, rank, is_rel), (query_id, n_rel)."""
    rel = F.when(F.col("is_rel"), 1.0).otherwise(0.0)
    running = Window.partitionBy("query_id").orderBy("rank")
    top = ranked.where(F.col("rank") <= depth).withColumn("hits", F.sum(rel).over(running))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, rel).otherwise(0.0))
    ks = sorted({*recall, *precision})
    per = top.groupBy("query_id").agg(F.sum(rel * F.col("hits") / F.col("rank")).alias("ap"), F.sum(rel / F.log2(F.col("rank") + 1.0)).alias("dcg"), *(at(k).alias(f"h{k}") for k in ks))
    full = totals.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    some = F.col("n_rel") > 0
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = [F.avg(zero(f"h{k}") / F.greatest(F.col("n_rel"), F.lit(1))).alias(f"Recall@{k}") for k in recall]
    out += [F.avg(zero(f"h{k}") / k).alias(f"Precision@{k}") for k in precision]
    out.append(F.avg(F.when(some, zero("ap") / F.least(F.col("n_rel"), F.lit(depth)))).alias(f"mAP@{depth}"))
    if ndcg:
        out.append(F.avg(F.when(some, zero("dcg") / ideal)).alias(f"nDCG@{depth}"))
    return full.agg(*out)


def evaluate(images: DataFrame, captions: DataFrame, image_vectors: DataFrame, text_vectors: DataFrame, places: int = 4) -> DataFrame:
    """Fourteen measures of three tasks: (task, measure, value).

    ``image_vectors`` and ``text_vectors`` are (id, embedding) of image_id and caption_id. A
    caption's own image; images of its category, to rank 20; images of an image's category, itself
    excluded, to rank 50. Ties rank by id. A caption whose image has no vector counts as missed.
    """
    known = images.join(image_vectors.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    truth = ground_truth(known, captions)
    rows = truth["instance"].join(text_vectors, truth["instance"]["query_id"] == text_vectors["id"]).select("id", "embedding", "image_id")
    targets = rows.join(image_vectors.select(F.col("id").alias("image_id"), F.col("embedding").alias("target_embedding")), "image_id")
    ranks = search.target_ranks(targets.select("id", "embedding", F.col("image_id").alias("target_id"), "target_embedding"), image_vectors)
    full = text_vectors.select(F.col("id").alias("query_id")).join(ranks, "query_id", "left")
    within = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"Recall@{k}")
    instance = full.agg(within(1), within(5), within(10), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("MRR"))
    kinds = known.select(F.col("image_id").alias("id"), F.col("category").alias("found"))

    def graded(queries: DataFrame, truth: DataFrame, depth: int, **what) -> DataFrame:
        ranked = search.search_all(queries, image_vectors, depth).join(kinds, "id").join(truth.select("query_id", "category"), "query_id")
        totals = queries.select(F.col("id").alias("query_id")).join(truth.select("query_id", "n_rel"), "query_id", "left").fillna(0, ["n_rel"])
        return _measures(ranked.select("query_id", "rank", (F.col("found") == F.col("category")).alias("is_rel")), totals, depth, **what)

    tasks = {
        "text_to_image_instance": instance,
        "text_to_image_category": graded(text_vectors, truth["category"], CATEGORY_DEPTH, recall=(5, 10, 20), ndcg=True),
        "image_to_image_class": graded(image_vectors, truth["class"], CLASS_DEPTH, recall=(10,), precision=(1, 5, 10)),
    }
    out = None
    for task, row in tasks.items():
        pairs = F.array(*(F.struct(F.lit(c).alias("measure"), F.round(F.col(f"`{c}`"), places).alias("value")) for c in row.columns))
        part = row.select(F.lit(task).alias("task"), F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    return out


def random_vectors(ids: DataFrame, dimension: int = 512, seed: int = 42) -> DataFrame:
    """(id, embedding) of unit vectors drawn for each id alone: the same ones in any order, session and partitioning."""
    kind = ids.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            names = batch.column("id").to_pylist()
            drawn = np.array([np.random.default_rng([seed, *str(n).encode()]).standard_normal(dimension) for n in names]).reshape(-1, dimension)
            drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(drawn.astype(np.float32)), pa.list_(pa.float32()))], names=["id", "embedding"])

    return ids.select("id").mapInArrow(run, f"id {kind}, embedding array<float>")


def synthetic_benchmark(images: DataFrame, captions: DataFrame, dimension: int = 512) -> DataFrame:
    """``evaluate`` on random vectors: what chance gives."""
    return evaluate(images, captions, random_vectors(images.select(F.col("image_id").alias("id")), dimension), random_vectors(captions.select(F.col("caption_id").alias("id")), dimension, 43))


def first_samples(images: DataFrame, count: int, position: Column) -> DataFrame:
    """The first images by position: the sampling option of an evaluation run."""
    return images.orderBy(position).limit(count)
