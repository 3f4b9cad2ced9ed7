"""Exact quantiles of groups of any size, by refining a histogram around the wanted ranks.

A group of at most ``limit`` values is left to Spark's own percentile, whose buffer has its
distinct values. For larger ones, of which there are at most (rows / limit), values are counted
by octave, then by equal parts of the span of values (from its least to its greatest) in which a
wanted rank lies, until a span has one value or few enough to sort. Counts are partial
aggregates, spans are broadcast (a row each per large group and rank), and no task ever has
more than ``limit`` values or ``BINS`` counts of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquarry.functions.scalars import is_finite
from terraquarry.storage import release, stored

LIMIT = 1 << 16
BINS = 1 << 14


def _octave(x: Column) -> Column:
    """A number that grows with x, the same between neighbouring powers of two."""
    power = F.floor(F.log2(F.abs(x))) + 1100  # the least double is 2 ** -1074
    return F.when(x == 0, 0).when(x > 0, power).otherwise(-power)


def _part(x: Column, low: Column, high: Column) -> Column:
    share = F.when(high > low, (x / 2 - low / 2) / (high / 2 - low / 2)).otherwise(0.0)  # halves: the span may be over the greatest double
    return F.least(F.floor(share * BINS), F.lit(BINS - 1))


def order_statistics(values: DataFrame, ranks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, rank, value): the values at some ranks (from 0) of keys. ``values`` has key and x (finite), ``ranks`` key and rank."""
    spans_of = values.join(F.broadcast(ranks.select("key").distinct()), "key").groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    rounds = [stored(ranks.join(spans_of, "key").withColumn("base", F.lit(0).cast("long")).select("key", "rank", "low", "high", "n", "base"), "ranks")]
    wide = (F.col("low") < F.col("high")) & (F.col("n") > limit)
    while not (open_ := rounds[-1].where(wide)).isEmpty():
        inside = values.join(F.broadcast(open_.select("key", "low", "high").distinct()), "key").where("x >= low AND x <= high")
        part = _octave(F.col("x")) if len(rounds) == 1 else _part(F.col("x"), F.col("low"), F.col("high"))
        counts = inside.groupBy("key", "low", "high", part.alias("part")).agg(F.count("*").alias("m"), F.min("x").alias("to_low"), F.max("x").alias("to_high"))
        below = F.coalesce(F.sum("m").over(Window.partitionBy("key", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = F.col("rank") - F.col("base")
        hit = open_.join(counts.withColumn("below", below), ["key", "low", "high"]).where((at >= F.col("below")) & (at < F.col("below") + F.col("m")))
        narrower = hit.select("key", "rank", F.col("to_low").alias("low"), F.col("to_high").alias("high"), F.col("m").alias("n"), (F.col("base") + F.col("below")).alias("base"))
        rounds.append(stored(narrower, "ranks"))
    closed = reduce(DataFrame.unionByName, (r.where(~wide) for r in rounds))
    few = closed.where("low < high")
    within = values.join(F.broadcast(few.select("key", "low", "high").distinct()), "key").where("x >= low AND x <= high")
    placed = within.withColumn("_at", F.row_number().over(Window.partitionBy("key", "low", "high").orderBy("x")) - 1)
    placed = few.join(placed, ["key", "low", "high"]).where(F.col("_at") == F.col("rank") - F.col("base")).select("key", "rank", F.col("x").alias("value"))
    found = stored(closed.where("low = high").select("key", "rank", F.col("low").alias("value")).unionByName(placed), "order-statistics")
    release(*rounds)
    return found


def any_large(rows: DataFrame, by: list[str], limit: int = LIMIT) -> bool:
    """Whether a group has more rows than ``limit``."""
    return not rows.groupBy(*by).count().where(F.col("count") > limit).isEmpty()


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: list[float], limit: int = LIMIT, large_ones: bool = True) -> DataFrame:
    """(by, q): the quantiles of each group's finite values at some shares, interpolated, as an array; null for a group without any.

    Null keys are a group. The result of large groups is exact, not an approximation. Whoever
    knows that there are none (``any_large``) says so by ``large_ones``, and spares a count.
    """
    for share in shares:
        if not 0 <= share <= 1:
            raise ValueError("shares must be 0 to 1")
    x = value.cast("double")
    given = rows.select(F.struct(*by).alias("key"), F.when(is_finite(x), x).alias("x"))
    exact = F.percentile("x", F.array(*(F.lit(float(s)) for s in shares)))
    names = [F.col(f"key.{c}").alias(c) for c in by]
    if not large_ones or not any_large(given, ["key"], limit):
        return given.groupBy("key").agg(exact.alias("q")).select(*names, "q")
    large = stored(given.groupBy("key").agg(F.count("x").alias("size")).where(F.col("size") > limit), "large-groups")
    small = given.join(F.broadcast(large.select("key")), "key", "left_anti").groupBy("key").agg(exact.alias("q"))
    position = lambda s: (F.col("size") - 1) * F.lit(float(s))
    wanted = F.array_distinct(F.array(*(f(position(s)).cast("long") for s in shares for f in (F.floor, F.ceil))))
    values = given.where("x IS NOT NULL").join(F.broadcast(large.select("key")), "key")
    at = order_statistics(values, large.select("key", F.explode(wanted).alias("rank")), limit)
    looked = large.join(at.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")), "key")

    def mixed(s: float) -> Column:
        low, high = (F.col("at")[f(position(s)).cast("long")] for f in (F.floor, F.ceil))
        part = position(s) - F.floor(position(s))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return small.unionByName(looked.select("key", F.array(*(mixed(s) for s in shares)).alias("q"))).select(*names, "q")


def median(rows: DataFrame, by: list[str], value: Column, name: str = "median", limit: int = LIMIT, large_ones: bool = True) -> DataFrame:
    """(by, name): the exact median of each group."""
    return quantiles(rows, by, value, [0.5], limit, large_ones).select(*by, F.col("q")[0].alias(name))
