"""Retrieval metrics over ranked lists (query_id, rank, is_rel) and totals (query_id, n_rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """Recall@1 (hit), MRR, recall@k, precision@k, mAP@k and nDCG@k as one row.

    The denominator of precision is k, that of recall at least 1; queries with nothing
    relevant don't count in mAP and nDCG. Only the k first ranks of a query are held.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rel = F.when(F.col("is_rel"), 1.0).otherwise(0.0)
    top = ranked.where(F.col("rank") <= k).withColumn("hits", F.sum(rel).over(order))
    per = top.groupBy("query_id").agg(
        F.sum(rel).alias("n_hit"), F.min(F.when(F.col("is_rel"), F.col("rank"))).alias("first"),
        F.sum(rel * F.col("hits") / F.col("rank")).alias("ap"), F.sum(rel / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("n_rel"), F.lit(k).cast("long"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    full = totals.join(per, "query_id", "left")
    some = F.col("n_rel") > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return full.agg(
        F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("recall_at_1"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(zero("n_hit") / F.greatest(F.col("n_rel"), F.lit(1))).alias("recall_at_k"),
        F.avg(zero("n_hit") / k).alias("precision_at_k"),
        F.avg(F.when(some, zero("ap") / F.least(F.col("n_rel"), F.lit(k)))).alias("map_at_k"),
        F.avg(F.when(some, zero("dcg") / ideal)).alias("ndcg_at_k"),
    )
