"""Band statistics, class distributions, rollups and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_statistics(pixels: DataFrame, by: str, value: str, nodata: float | None = None, saturated: float = 10000.0) -> DataFrame:
    """Extremes, mean, linear percentiles and saturation of each band's valid pixels, with valid and total counts.

    Exact percentiles keep a count per distinct value and merge map-side; digital numbers have at most 65,536.
    """
    x = F.col(value).cast("double")
    valid = x if nodata is None else F.when(x != nodata, x)
    stats = pixels.groupBy(by).agg(
        F.min(valid).alias("min"), F.max(valid).alias("max"), F.avg(valid).alias("mean"),
        F.percentile(valid, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("p"),
        F.count(valid).alias("n_valid"), F.count("*").alias("n_total"), F.count_if(valid > saturated).alias("n_saturated"),
    )
    return stats.select(
        by, "min", "max", "mean", F.col("p")[0].alias("p01"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p99"), "n_valid", "n_total", "n_saturated"
    )


#: The classes of the scene classification layer, by code.
CLASSES = ("NO_DATA", "SATURATED_OR_DEFECTIVE", "DARK_AREA_PIXELS", "CLOUD_SHADOWS", "VEGETATION", "NOT_VEGETATED", "WATER", "UNCLASSIFIED", "CLOUD_MEDIUM_PROBABILITY", "CLOUD_HIGH_PROBABILITY", "THIN_CIRRUS", "SNOW")
#: Codes of clouds.
CLOUDS = (8, 9, 10)


def array_statistics(data: Column, nodata: Column, saturated: float = 10000.0) -> Column:
    """min, max, mean, p1, p50, p99, n_above, pct_above, n_valid, n_total of a raster held as an array; without valid pixels, zeros.

    Percentiles are interpolated. The array of one raster is sorted; nothing is shuffled.
    """
    valid = F.array_sort(F.filter(data, lambda x: x.isNotNull() & ~F.coalesce(x == nodata, F.lit(False))))

    def measured(v: Column) -> Column:
        n = F.size(v)
        value = lambda i: F.get(v, i.cast("int")).cast("double")

        def at(share: float) -> Column:
            place = (n - 1) * F.lit(share)
            low, high = F.floor(place), F.ceil(place)
            return value(low) + (value(high) - value(low)) * (place - low)

        above = F.size(F.filter(v, lambda x: x > saturated)).cast("long")
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return F.struct(
            zero(value(F.lit(0))).alias("min"), zero(value(n - 1)).alias("max"), zero(F.try_divide(total, n)).alias("mean"), zero(at(0.01)).alias("p1"), zero(at(0.5)).alias("p50"), zero(at(0.99)).alias("p99"),
            above.alias("n_above"), F.round(zero(F.try_divide(100.0 * above, n)), 4).alias("pct_above"), n.cast("long").alias("n_valid"), F.size(data).cast("long").alias("n_total"),
        )

    return F.transform(F.array(valid), measured)[0]


def class_report(data: Column) -> Column:
    """Counts by class code of a class layer held as an array, and the shares of clouds, shadow, vegetation, water and bare soil."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda k: F.size(F.filter(data, lambda x: x == k)).cast("long"))

    def described(c: Column) -> Column:
        share = lambda *codes: F.round(F.coalesce(F.try_divide(100.0 * sum((c[k] for k in codes[1:]), c[codes[0]]), F.size(data)), F.lit(0.0)), 4)
        return F.struct(c.alias("counts"), share(*CLOUDS).alias("cloud_pct"), share(3).alias("shadow_pct"), share(4).alias("vegetation_pct"), share(6).alias("water_pct"), share(5).alias("bare_soil_pct"))

    return F.transform(F.array(counts), described)[0]


def class_distribution(pixels: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain, absent classes included, with their share of all pixels in it."""
    counts = pixels.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    whole = pixels.sparkSession.createDataFrame([(d,) for d in domain], "class string")
    found = whole.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = found.agg(F.sum("n").alias("total"))  # one row
    return found.join(F.broadcast(total)).select("class", "n", F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule (or leave it unknown), with the names of the broken rules in the order given."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.withColumn("errors", F.concat_ws(",", broken)).where(F.col("errors") != "").select(*keys, "errors")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def affine_fit(points: DataFrame, x: str, y: str, target: str) -> DataFrame:
    """Least squares target = a x + b y + c by centred normal equations: one aggregation, no row leaves its executor."""
    f = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(target).cast("double").alias("z")).dropna()
    s = f.agg(
        F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"),
        F.covar_pop("y", "z").alias("yz"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"),
    )
    det = F.expr("nullif(xx * yy - xy * xy, 0D)")
    s = s.withColumn("a", F.expr("xz * yy - yz * xy") / det).withColumn("b", F.expr("yz * xx - xz * xy") / det)
    return s.select("a", "b", F.expr("mz - a * mx - b * my").alias("c"))
