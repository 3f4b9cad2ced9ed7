"""The query catalogue: each entry applies library operators to whole tables, with its DuckDB form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquarry.functions import scalars as S
from terraquarry.operators import change, detection, evaluation, footprints, index, metrics, pairing, parts, search, selection, stats, suppression as false_alarms, tiling
from terraquarry.sources.tables import table
from terraquarry.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Pixels a row and a tile of the raster that ``events`` stands in for.
WIDTH, PIXELS = 100, 10_000
DOMAIN = ["F", "O", "P", "X"]


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(sql: str) -> str:
    return f"floor(({sql}) * 1000000 + 0.5) / 1000000"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: S.rounded(F.col(n)) for n in names})


def first_vector(spark: SparkSession, sf_dir: str):
    """The query vector, one row of one column, as a literal."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in (row[0] if row else [])))


#: Scores are ranked to 12 places and shown to 6.
EXACT = "floor(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 1e12 + 0.5) / 1e12"
TOP = f"SELECT e.vec_id, {r6(EXACT)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"{TOP} ORDER BY {EXACT} DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10).select("vec_id", "score")


@query(f"{TOP} WHERE e.label = 3 AND e.vec_id >= 1 ORDER BY {EXACT} DESC, vec_id LIMIT 10")
def filtered_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("label = 3 AND vec_id >= 1")
    return search.top_k(rows, first_vector(spark, sf_dir), 10).select("vec_id", "score")


ALL = f"""
WITH scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {EXACT} AS score, q.label = e.label AS is_rel
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored)
"""


def _similar(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.search_all(rows.where("id % 50 = 0"), rows, 10)


@query(ALL + f"SELECT query_id, id, {r6('score')} AS score, rank FROM ranked WHERE rank <= 10")
def similar_tiles_all(spark, sf_dir):
    return _similar(spark, sf_dir)


@query(
    ALL
    + f""", tot AS (SELECT query_id, sum(is_rel::INT) AS n FROM ranked GROUP BY 1),
hit AS (SELECT *, sum(is_rel::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM ranked WHERE rank <= 10),
per AS (SELECT query_id, sum(is_rel::INT) AS h, min(CASE WHEN is_rel THEN rank END) AS f,
  sum(CASE WHEN is_rel THEN hits / rank ELSE 0 END) AS ap, sum(CASE WHEN is_rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hit GROUP BY 1)
SELECT {r6("avg(coalesce((f = 1)::INT, 0))")} AS recall_at_1, {r6("avg(coalesce(1.0::DOUBLE / f, 0))")} AS mrr,
  {r6("avg(h / greatest(n, 1))")} AS recall_at_k, {r6("avg(h / 10.0::DOUBLE)")} AS precision_at_k,
  {r6("avg(CASE WHEN n > 0 THEN ap / least(n, 10) END)")} AS map_at_k,
  {r6("avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END)")} AS ndcg_at_k
FROM tot JOIN per USING (query_id)"""
)
def retrieval_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    queries = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    ranked = _similar(spark, sf_dir).join(queries, "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    ranked = ranked.select("query_id", "rank", (F.col("label") == F.col("q_label")).alias("is_rel"))
    totals = queries.join(sizes, queries["q_label"] == sizes["label"]).select("query_id", "n_rel")
    out = metrics.retrieval_metrics(ranked, totals, 10)
    return rounded(out, *out.columns)


NORM = "sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query(f"SELECT {r6(f'min({NORM})')} AS min_norm, {r6(f'max({NORM})')} AS max_norm, count(*) FILTER (abs({NORM} - 1) > 0.002) AS n_bad FROM embeddings")
def norm_check(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select(S.norm(F.col("embedding")).alias("n"))
    return rounded(n.agg(F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.count_if(F.abs(F.col("n") - 1) > 0.002).alias("n_bad")), "min_norm", "max_norm")


EVENT_KEY = ["event_type", "user_id"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*EVENT_KEY, F.col("event_id").alias("scene_id"), F.col("ts").alias("acquired"))


@query(
    """WITH pairs AS (SELECT a.event_type, a.user_id, a.event_id AS scene_id, b.event_id AS partner_id, epoch_us(b.ts) - epoch_us(a.ts) AS d
  FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.ts <> b.ts)
SELECT event_type, user_id, scene_id, partner_id, d / 1000000.0::DOUBLE AS delta_seconds FROM pairs
QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY abs(d), d DESC, partner_id) = 1"""
)
def nearest_in_time(spark, sf_dir):
    return pairing.nearest_in_time(_events(spark, sf_dir), EVENT_KEY)


@query(
    """SELECT a.o_custkey, a.o_orderkey AS reference_id, b.o_orderkey AS comparison_id, date_diff('second', a.o_orderdate, b.o_orderdate) / 86400.0::DOUBLE AS delta_days
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate WHERE date_diff('second', a.o_orderdate, b.o_orderdate) / 86400.0::DOUBLE <= 90"""
)
def all_pairs_90_days(spark, sf_dir):
    """The pairs of ``all_pairs`` that are at most 90 days apart."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("acquired"))
    return pairing.all_pairs(orders, ["o_custkey"], max_days=90)


@query(
    """SELECT a.o_custkey, a.o_orderkey AS reference_id, b.o_orderkey AS comparison_id, date_diff('second', a.o_orderdate, b.o_orderdate) / 86400.0::DOUBLE AS delta_days
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate"""
)
def all_pairs(spark, sf_dir):
    """Every pair, however far apart."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("acquired"))
    return pairing.all_pairs(orders, ["o_custkey"])


@query(
    """SELECT user_id, n_left, n_right FROM (SELECT user_id, count(*) AS n_left FROM events WHERE event_type = 'click' GROUP BY 1)
JOIN (SELECT user_id, count(*) AS n_right FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id)"""
)
def scene_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return pairing.scene_pairs(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"])


@query(
    """SELECT l_orderkey, min(l_quantity) AS west, min(l_extendedprice) AS south, max(l_quantity) AS east, max(l_extendedprice) AS north, count(*) AS n_tiles
FROM lineitem GROUP BY 1"""
)
def scene_envelope(spark, sf_dir):
    return pairing.scene_envelope(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice")


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CAST(p_size AS DOUBLE) AS west", "p_retailprice / 100D AS south", "p_size + 5D AS east", "p_retailprice / 100D + 4D AS north"
    )


BOXES = "SELECT p_partkey, p_size::DOUBLE AS west, p_retailprice / 100 AS south, p_size + 5.0::DOUBLE AS east, p_retailprice / 100 + 4 AS north FROM part"


@query(f"SELECT p_partkey FROM ({BOXES}) WHERE west <= 25 AND east >= 10 AND south <= 14 AND north >= 11")
def bbox_filter(spark, sf_dir):
    return search.metadata_filter(_boxes(spark, sf_dir), bbox=(10, 11, 25, 14)).select("p_partkey")


WIDE, HIGH = "(least(east, 25) - greatest(west, 10))", "(least(north, 14) - greatest(south, 11))"


@query(
    f"""SELECT p_partkey, {r6(f"CASE WHEN {WIDE} > 0 AND {HIGH} > 0 THEN {WIDE} * {HIGH} / ((east - west) * (north - south) + 45 - {WIDE} * {HIGH}) ELSE 0 END")} AS iou
FROM ({BOXES})"""
)
def bbox_iou(spark, sf_dir):
    mine, other = [F.col(c) for c in ("west", "south", "east", "north")], [F.lit(float(x)) for x in (10, 11, 25, 14)]
    return _boxes(spark, sf_dir).select("p_partkey", S.rounded(S.box_iou(mine, other)).alias("iou"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20 23:59:59.999999'")
def date_range(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("acquired"))
    return search.metadata_filter(rows, date_from="2024-01-02", date_to="2024-01-20").select("event_id")


V = "CASE WHEN l_quantity <> 1 THEN l_quantity END"


@query(
    f"""SELECT l_returnflag, min({V}) AS min, max({V}) AS max, {r6(f"avg({V})")} AS mean, {r6(f"quantile_cont({V}, 0.01)")} AS p01, {r6(f"quantile_cont({V}, 0.5)")} AS p50,
{r6(f"quantile_cont({V}, 0.99)")} AS p99, count({V}) AS n_valid, count(*) AS n_total, count(*) FILTER ({V} > 40) AS n_saturated FROM lineitem GROUP BY 1"""
)
def band_stats(spark, sf_dir):
    out = stats.band_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", nodata=1, saturated=40)
    return rounded(out, "mean", "p01", "p50", "p99")


@query(
    f"""WITH d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS class), n AS (SELECT class, count(l_orderkey) AS n FROM d LEFT JOIN lineitem ON class = l_linestatus GROUP BY 1)
SELECT class, n, {r6("coalesce(n * 100.0::DOUBLE / nullif(sum(n) OVER (), 0), 0)")} AS percent FROM n"""
)
def class_distribution(spark, sf_dir):
    return rounded(stats.class_distribution(table(spark, sf_dir, "lineitem"), "l_linestatus", DOMAIN), "percent")


def _raster(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        f"event_id div {PIXELS} AS pair_id", f"(event_id % {PIXELS}) div {WIDTH} AS r", f"event_id % {WIDTH} AS c", "value AS magnitude", "value * 1.5D AS band2", "value AS band1"
    )


RASTER = f"SELECT event_id // {PIXELS} AS pair_id, (event_id % {PIXELS}) // {WIDTH} AS r, event_id % {WIDTH} AS c, value AS magnitude FROM events"


@query(
    f"""WITH p AS ({RASTER}) SELECT a.pair_id, a.r // 2 AS r, a.c, {r6("sqrt(((b.magnitude - a.magnitude) / 10000) ** 2 + ((b.magnitude * 1.5 - a.magnitude * 1.5) / 10000) ** 2)")} AS magnitude
FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.c = b.c AND a.r + 1 = b.r WHERE a.r % 2 = 0 AND a.magnitude > 0 AND b.magnitude > 0"""
)
def change_magnitude(spark, sf_dir):
    p = _raster(spark, sf_dir)
    even, odd = (p.where(f"r % 2 = {i}").withColumn("r", F.expr("r div 2")) for i in (0, 1))
    return rounded(change.change_magnitude(even, odd, ["band1", "band2"]), "magnitude")


@query(
    f"""SELECT pair_id, count(*) AS n_valid, {r6("avg(magnitude)")} AS mean, {r6("median(magnitude)")} AS median, {r6("quantile_cont(magnitude, 0.95)")} AS p95,
{r6("quantile_cont(magnitude, 0.99)")} AS p99, max(magnitude) AS max, {r6("stddev_pop(magnitude)")} AS std, {r6(f"count(*) / {PIXELS}.0::DOUBLE")} AS valid_pixel_ratio,
CASE WHEN count(*) / {PIXELS} < 0.1 THEN 'insufficient_valid_pixels' ELSE 'success' END AS status FROM ({RASTER}) GROUP BY 1"""
)
def change_summary(spark, sf_dir):
    return rounded(change.summary(_raster(spark, sf_dir), PIXELS), "mean", "median", "p95", "p99", "std", "valid_pixel_ratio")


@query(f"""SELECT pair_id, {r6("quantile_cont(magnitude, 0.95)")} AS p95, {r6("quantile_cont(magnitude, 0.99)")} AS p99 FROM ({RASTER}) GROUP BY 1""")
def change_percentiles(spark, sf_dir):
    return rounded(change.percentiles(_raster(spark, sf_dir)), "p95", "p99")


@query(
    f"""WITH p AS ({RASTER}) SELECT p.pair_id, p.r, p.c FROM p SEMI JOIN (SELECT * FROM p WHERE r < 50 AND c < 50 AND (r + c) % 12 NOT IN (0, 1, 3, 8, 9, 10, 11)) s
ON p.pair_id = s.pair_id AND p.r // 2 = s.r AND p.c // 2 = s.c"""
)
def scl_expand_mask(spark, sf_dir):
    p = _raster(spark, sf_dir)
    classes = p.where("r < 50 AND c < 50").selectExpr("pair_id", "r AS r2", "c AS c2", "(r + c) % 12 AS class")
    return change.mask_classes(p, classes).select("pair_id", "r", "c")


THRESHOLD = "median(magnitude) + 1.4826 * mad(magnitude)"


@query(
    f"""SELECT event_type, {r6("median(magnitude)")} AS median, {r6("mad(magnitude)")} AS mad, {r6("median(magnitude) + 3 * 1.4826 * mad(magnitude)")} AS threshold
FROM (SELECT event_type, value AS magnitude FROM events) GROUP BY 1"""
)
def mad_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("magnitude"))
    return rounded(change.thresholds(e, by="event_type").select("event_type", "median", "mad", "threshold"), "median", "mad", "threshold")


@query(
    f"""SELECT l_returnflag, {r6("quantile_cont(l_extendedprice, 0.01)")} AS p01, {r6("quantile_cont(l_extendedprice, 0.25)")} AS p25, {r6("quantile_cont(l_extendedprice, 0.5)")} AS p50,
{r6("quantile_cont(l_extendedprice, 0.99)")} AS p99, {r6("quantile_cont(l_extendedprice, 1)")} AS top, {r6("median(l_extendedprice) + 3 * 1.4826 * mad(l_extendedprice)")} AS threshold FROM lineitem GROUP BY 1"""
)
def exact_quantiles(spark, sf_dir):
    """Quantiles and a threshold of groups that are too large for one buffer (here: of over 1,000 values), by refined histograms."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("magnitude"))
    q = selection.quantiles(rows, ["l_returnflag"], F.col("magnitude"), [0.01, 0.25, 0.5, 0.99, 1.0], limit=1000)
    limits = change.thresholds(rows, by="l_returnflag", limit=1000).select("l_returnflag", "threshold")
    named = q.select("l_returnflag", *(F.col("q")[i].alias(n) for i, n in enumerate(("p01", "p25", "p50", "p99", "top")))).join(limits, "l_returnflag")
    return rounded(named, "p01", "p25", "p50", "p99", "top", "threshold")


NEAR = f"""WITH RECURSIVE p AS ({RASTER}), t AS (SELECT pair_id, {THRESHOLD} AS threshold FROM p GROUP BY 1),
cand AS (SELECT p.*, threshold FROM p JOIN t USING (pair_id) WHERE magnitude > threshold),
near AS (SELECT a.pair_id, a.r, a.c, any_value(a.magnitude) AS magnitude, any_value(a.threshold) AS threshold, count(b.r) AS neighbors FROM cand a
  LEFT JOIN cand b ON a.pair_id = b.pair_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY 1, 2, 3)"""


@query(f"{NEAR} SELECT pair_id, r, c, neighbors FROM near")
def neighbors8(spark, sf_dir):
    return change.neighbors8(change.candidates(_raster(spark, sf_dir), k=1.0)).select("pair_id", "r", "c", "neighbors")


COMPONENTS = f"""{NEAR}, kept AS (SELECT * FROM near WHERE neighbors >= 2),
reach AS (SELECT pair_id, r, c, r * {WIDTH} + c AS component FROM kept
  UNION SELECT k.pair_id, k.r, k.c, x.component FROM reach x JOIN kept k ON k.pair_id = x.pair_id AND abs(k.r - x.r) <= 1 AND abs(k.c - x.c) <= 1),
named AS (SELECT pair_id, r, c, min(component) AS component FROM reach GROUP BY 1, 2, 3),
sized AS (SELECT *, count(*) OVER (PARTITION BY pair_id, component) AS area FROM named)
SELECT n.pair_id, n.r, n.c, neighbors, component, area,
  {r6("least(greatest(0.5 * (magnitude - threshold) / (magnitude + threshold) + neighbors / 16, 0.05), 1)")} AS confidence
FROM near n JOIN sized s ON n.pair_id = s.pair_id AND n.r = s.r AND n.c = s.c WHERE area >= 4"""


@query(COMPONENTS)
def suppression(spark, sf_dir):
    return rounded(change.suppress(_raster(spark, sf_dir), WIDTH, k=1.0), "confidence")


@query(
    """WITH d AS (SELECT p_partkey AS scene_id, (p_size * 40 + 100)::BIGINT AS w FROM part),
o AS (SELECT scene_id, w, CASE WHEN w <= 256 THEN [0::BIGINT] ELSE list_sort(list_distinct(list_concat(range(0, w - 255, 256), [w - 256]))) END AS offs FROM d)
SELECT a.scene_id, (i - 1)::INT AS row_idx, (j - 1)::INT AS col_idx, a.offs[i] AS row_off, a.offs[j] AS col_off, least(256, w - a.offs[j]) AS width, least(256, w - a.offs[i]) AS height
FROM o a, unnest(range(1, len(offs) + 1)) AS x(i), unnest(range(1, len(offs) + 1)) AS y(j)"""
)
def tile_windows(spark, sf_dir):
    side = (F.col("p_size") * 40 + 100).cast("long")
    return tiling.tile_windows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), side.alias("width"), side.alias("height")))


def _rest(rest: str, length: str) -> str:
    """Windows whose last one on each axis starts and ends by a rule."""
    return f"""WITH d AS (SELECT p_partkey AS scene_id, (p_size * 40 + 100)::BIGINT AS w FROM part),
o AS (SELECT scene_id, w, CASE WHEN w <= 256 THEN [0::BIGINT] ELSE range(0, {rest}, 256) END AS offs FROM d)
SELECT a.scene_id, (i - 1)::INT AS row_idx, (j - 1)::INT AS col_idx, a.offs[i] AS row_off, a.offs[j] AS col_off, {length.format('a.offs[j]')} AS width, {length.format('a.offs[i]')} AS height
FROM o a, unnest(range(1, len(offs) + 1)) AS x(i), unnest(range(1, len(offs) + 1)) AS y(j)"""


def _sides(spark, sf_dir):
    side = (F.col("p_size") * 40 + 100).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), side.alias("width"), side.alias("height"))


@query(_rest("w", "least(256, w - {})"))
def tile_windows_truncate(spark, sf_dir):
    return tiling.tile_windows(_sides(spark, sf_dir), strategy="truncate")


@query(_rest("w", "256::BIGINT"))
def tile_windows_pad(spark, sf_dir):
    return tiling.tile_windows(_sides(spark, sf_dir), strategy="pad")


@query(r"SELECT n_nationkey, replace(lower(n_name), '_', ' ') AS category FROM nation WHERE regexp_full_match(n_name, '[a-zA-Z_]+') UNION ALL SELECT n_nationkey, 'unknown' FROM nation WHERE NOT regexp_full_match(n_name, '[a-zA-Z_]+')")
def category_extract(spark, sf_dir):
    name = F.concat("n_name", F.lit("_"), F.col("n_nationkey").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "nation").select("n_nationkey", S.category_of(name).alias("category"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def modality_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query(
    """SELECT * FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN coalesce(o_totalprice < 100000, false) THEN NULL ELSE 'price' END,
CASE WHEN coalesce(o_orderstatus IN ('F', 'O'), false) THEN NULL ELSE 'status' END) AS errors FROM orders) WHERE errors <> ''"""
)
def validator_rules(spark, sf_dir):
    return stats.violations(table(spark, sf_dir, "orders"), ["o_orderkey"], {"price": F.col("o_totalprice") < 100000, "status": F.col("o_orderstatus").isin("F", "O")})


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def union_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_members(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return stats.duplicates(table(spark, sf_dir, "events"), ["user_id"])


@query(
    f"""WITH s AS (SELECT var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz,
covar_pop(l_discount, l_extendedprice) AS yz, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz FROM lineitem),
f AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM s)
SELECT {r6("a")} AS a, {r6("b")} AS b, {r6("mz - a * mx - b * my")} AS c FROM f"""
)
def affine_lstsq(spark, sf_dir):
    return rounded(stats.affine_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice"), "a", "b", "c")


@query(
    """SELECT l_orderkey, count(*) AS n_points, sum(l_quantity - 20) AS sum_col FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 GROUP BY 1"""
)
def gcp_translate(spark, sf_dir):
    point = F.struct(F.col("l_quantity").alias("source_col"), F.lit(0.0).alias("source_row"))
    scenes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(point).alias("gcps"))
    moved = scenes.select("l_orderkey", tiling.translate_gcps(F.col("gcps"), F.lit(20.0), F.lit(0.0), 10, 10, 10.0).alias("g")).where(F.size("g") > 0)
    return moved.select("l_orderkey", F.size("g").cast("long").alias("n_points"), F.aggregate("g", F.lit(0.0), lambda s, g: s + g["local_col"]).alias("sum_col"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(least(greatest(l_extendedprice / 10000, 0), 0.35) / 0.35 * 255.0::DOUBLE, 0)::INT AS byte FROM lineitem")
def rgb_scale(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", tiling.optical_scale(F.col("l_extendedprice")).alias("byte"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r6('log10(1 + l_extendedprice)')} AS level FROM lineitem")
def sar_scale(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.rounded(F.log10(1 + F.col("l_extendedprice"))).alias("level"))


def _tile_index(spark, sf_dir):
    """Events as tiles of two modalities: a scene each, a place for each user and kind."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('t', event_id) AS tile_id", "concat('s', event_id) AS scene_id", "IF(event_type = 'view', 'sar', 'optical') AS modality", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS acquisition_datetime_utc",
        "CAST(user_id AS INT) AS row_idx", "ascii(event_type) AS col_idx", "array(0D, 0D, 1D + user_id % 3, 1D) AS bounds_wgs84", "array(0D, 0D, 1D, 1D) AS bounds_projected", "'EPSG:32643' AS crs", "'d' AS tile_directory",
    )


MET = """t AS (SELECT *, CASE WHEN event_type = 'view' THEN 'sar' ELSE 'optical' END AS modality, ascii(event_type) AS kind, 1.0::DOUBLE + user_id % 3 AS east FROM events),
met AS (SELECT a.event_id AS q, b.event_id AS o, a.ts AS t0, b.ts AS t1, a.modality, a.user_id, a.kind, a.east AS e0, b.east AS e1, epoch_us(b.ts) - epoch_us(a.ts) AS d
  FROM t a JOIN t b ON a.modality = b.modality AND a.user_id = b.user_id AND a.kind = b.kind AND a.event_id <> b.event_id AND a.ts <> b.ts)"""


@query(
    f"""WITH {MET} SELECT 't' || q AS query_tile_id, row_number() OVER (PARTITION BY q ORDER BY abs(d), d < 0, 's' || o)::INT AS choice,
CASE WHEN d > 0 THEN 'pair__t' || q || '__t' || o ELSE 'pair__t' || o || '__t' || q END AS pair_id, abs(d) / 1000000.0::DOUBLE / 86400 AS temporal_delta_days FROM met"""
)
def counterparts_all(spark, sf_dir):
    return pairing.counterparts(_tile_index(spark, sf_dir)).select("query_tile_id", "choice", "pair_id", "temporal_delta_days")


@query(
    f"""WITH {MET} SELECT 'pair__t' || q || '__t' || o AS pair_id, modality, user_id::INT AS row_idx, kind::INT AS col_idx, 's' || q AS reference_scene_id, 's' || o AS comparison_scene_id,
CASE WHEN modality = 'sar' THEN 'unaligned_radar_grid' ELSE 'native_pixel_aligned' END AS alignment_type, CASE WHEN modality = 'sar' THEN 'grid_index_topological' ELSE 'grid_index_exact' END AS method, 1.0::DOUBLE AS iou FROM met WHERE d > 0"""
)
def pair_details(spark, sf_dir):
    pairs = pairing.all_tile_pairs(_tile_index(spark, sf_dir))
    return pairs.select("pair_id", "modality", "spatial.row_idx", "spatial.col_idx", "reference_scene_id", "comparison_scene_id", "alignment.alignment_type", "spatial.method", F.col("spatial.spatial_iou_wgs84").alias("iou"))


@query(
    f"""WITH d AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'optical' ELSE 'sar' END AS modality, TIMESTAMP '2024-01-01 12:00:00' + to_days(p_size) AS acquired FROM part JOIN ({BOXES}) USING (p_partkey))
SELECT p_partkey FROM d WHERE modality = 'optical' AND acquired >= TIMESTAMP '2024-01-05' AND acquired <= TIMESTAMP '2024-02-10 23:59:59.999999' AND west <= 45 AND east >= 10 AND south <= 14 AND north >= 11"""
)
def combined_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "IF(p_partkey % 2 = 0, 'optical', 'sar') AS modality", "TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(p_size) AS acquired")
    tiles = rows.join(_boxes(spark, sf_dir), "p_partkey")
    return search.metadata_filter(tiles, "optical", "2024-01-05", "2024-02-10", None, (10, 11, 45, 14)).select("p_partkey")


@query(
    COMPONENTS.replace("SELECT n.pair_id, n.r, n.c", ", found AS (SELECT n.pair_id, n.r, n.c") + f""")
SELECT pair_id, count(*) AS candidate_pixels, count(confidence) AS confirmed_pixels, {r6("avg(confidence)")} AS mean_confidence, max(confidence) AS max_confidence
FROM near LEFT JOIN found USING (pair_id, r, c) GROUP BY 1"""
)
def suppression_counts(spark, sf_dir):
    found = rounded(change.supported(change.candidates(_raster(spark, sf_dir), k=1.0), WIDTH), "confidence")
    out = found.groupBy("pair_id").agg(F.count("*").alias("candidate_pixels"), F.count("confidence").alias("confirmed_pixels"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"))
    return rounded(out, "mean_confidence")


LEVEL = "least(greatest(log10(1 + greatest({}, 0)) / {}, 0), 1)"


@query(
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even({LEVEL.format('l_extendedprice', 3.6)} * 255.0::DOUBLE, 0)::INT AS red, round_even({LEVEL.format('l_quantity', 3.2)} * 255.0::DOUBLE, 0)::INT AS green,
round_even(0.5::DOUBLE * ({LEVEL.format('l_extendedprice', 3.6)} + {LEVEL.format('l_quantity', 3.2)}) * 255.0::DOUBLE, 0)::INT AS blue FROM lineitem"""
)
def radar_image(spark, sf_dir):
    return tiling.radar_rgb(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "red", "green", "blue")


@query(
    """SELECT CASE WHEN lang = 'en' THEN 'optical' ELSE 'sar' END AS modality, NULL AS scene_id, count(*) AS n FROM documents GROUP BY 1
UNION ALL SELECT NULL, source, count(*) FROM documents GROUP BY source"""
)
def index_counts(spark, sf_dir):
    return index.group_counts(table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "optical").otherwise("sar").alias("modality"), F.col("source").alias("scene_id")))


#: Side of the tiles that ``events`` are dealt into, for change and suppression.
TILE_SIDE = 20
_CELLS = TILE_SIDE**2
TILES = f"""WITH RECURSIVE v AS (SELECT event_id // {_CELLS} AS t, event_id % {_CELLS} AS place, value::FLOAT::DOUBLE AS v, (value * 1.5)::FLOAT::DOUBLE AS w FROM events),
whole AS (SELECT t FROM v GROUP BY 1 HAVING count(*) = {_CELLS}),
pairs AS (SELECT a.t // 2 AS pair_id, a.t AS ta, b.t AS tb FROM whole a JOIN whole b ON b.t = a.t + 1 WHERE a.t % 2 = 0),
classes AS (SELECT t, place // 2 // {TILE_SIDE // 2} AS r2, place // 2 % {TILE_SIDE // 2} AS c2 FROM v WHERE place % 6 = 0 AND place < {_CELLS // 2} AND (place * 7 + t * 5) % 12 IN (0, 1, 3, 8, 9, 10, 11)),
m AS (SELECT pair_id, a.place // {TILE_SIDE} AS r, a.place % {TILE_SIDE} AS c, sqrt((b.v / 10000 - a.v / 10000) ** 2 + (b.w / 10000 - a.w / 10000) ** 2) AS x
  FROM pairs JOIN v a ON a.t = ta JOIN v b ON b.t = tb AND b.place = a.place WHERE a.v > 0 AND b.v > 0),
p AS (SELECT m.pair_id, r, c, x, x::FLOAT::DOUBLE AS magnitude FROM m JOIN pairs USING (pair_id) WHERE NOT EXISTS (SELECT 1 FROM classes k WHERE k.t IN (ta, tb) AND k.r2 = r // 2 AND k.c2 = c // 2)),
seen AS (SELECT pair_id, count(*) AS valid_pixels, avg(x) AS mean, median(x) AS median, quantile_cont(x, 0.95) AS p95, max(x) AS max, stddev_pop(x) AS std FROM p GROUP BY 1),
t AS (SELECT pair_id, median(magnitude) AS noise_median, mad(magnitude) AS noise_mad, median(magnitude) + 1.4826 * mad(magnitude) AS used FROM p GROUP BY 1),
cand AS (SELECT p.*, used::FLOAT::DOUBLE AS threshold FROM p JOIN t USING (pair_id) WHERE magnitude > used::FLOAT::DOUBLE),
near AS (SELECT a.pair_id, a.r, a.c, any_value(a.magnitude) AS magnitude, any_value(a.threshold) AS threshold, count(b.r) AS neighbors FROM cand a
  LEFT JOIN cand b ON a.pair_id = b.pair_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY 1, 2, 3),
kept AS (SELECT * FROM near WHERE neighbors >= 2),
reach AS (SELECT pair_id, r, c, r * {TILE_SIDE} + c AS component FROM kept
  UNION SELECT k.pair_id, k.r, k.c, x.component FROM reach x JOIN kept k ON k.pair_id = x.pair_id AND abs(k.r - x.r) <= 1 AND abs(k.c - x.c) <= 1),
named AS (SELECT pair_id, r, c, min(component) AS component FROM reach GROUP BY 1, 2, 3),
sized AS (SELECT *, count(*) OVER (PARTITION BY pair_id, component) AS area FROM named),
sure AS (SELECT n.pair_id, component, area, n.r, n.c, least(greatest(0.5 * (magnitude - threshold) / (magnitude + threshold) + neighbors / 16, 0.05), 1) AS confidence
  FROM near n JOIN sized s ON n.pair_id = s.pair_id AND n.r = s.r AND n.c = s.c WHERE area >= 4),
counted AS (SELECT pair_id, count(*) AS candidate_pixels FROM cand GROUP BY 1),
confirmed AS (SELECT pair_id, count(*) AS confirmed_pixels, count(DISTINCT component) AS n_components, avg(confidence) AS mean_confidence, max(confidence) AS max_confidence FROM sure GROUP BY 1)
"""


def _tile_rasters(spark, sf_dir):
    """Events as two-band tiles of 20 x 20 with a class layer of 10 x 10, whole tiles alone."""
    cell = table(spark, sf_dir, "events").selectExpr(f"event_id div {_CELLS} AS t", f"event_id % {_CELLS} AS place", "CAST(value AS FLOAT) AS v", "CAST(value * 1.5D AS FLOAT) AS w")
    tiles = cell.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("place", "v", "w"))).alias("x")).where(F.size("x") == _CELLS)
    half = TILE_SIDE // 2
    layer = F.transform(F.sequence(F.lit(0), F.lit(half**2 - 1)), lambda i: F.when(i % 3 == 0, (i * 14 + F.col("t") * 5) % 12).otherwise(4).cast("float"))
    band = lambda name, side, scale, nodata, data: F.struct(F.lit(name).alias("band"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.array(*map(F.lit, (scale, 0.0, 0.0, 0.0, -scale, 0.0))).alias("affine"), nodata.alias("nodata"), data.alias("data"))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    rows = F.array(band("B1", TILE_SIDE, 10.0, zero, F.col("x.v")), band("B2", TILE_SIDE, 10.0, zero, F.col("x.w")), band("SCL", half, 20.0, none, layer))
    return tiles.select("t", F.inline(rows)).select(F.concat(F.lit("t"), "t").alias("tile_id"), "t", "band", "height", "width", F.lit("EPSG:32643").alias("crs"), "affine", "nodata", "data")


def _compared_tiles(spark, sf_dir):
    rasters = _tile_rasters(spark, sf_dir)
    tiles = rasters.where("band = 'B1'").select("t")
    later = tiles.select((F.col("t") - 1).alias("t"), (F.col("t")).alias("u"))
    pairs = tiles.where("t % 2 = 0").join(later, "t").selectExpr("t div 2 AS pair_id", "concat('t', t) AS reference_tile_id", "concat('t', u) AS comparison_tile_id", "'optical' AS modality", "named_struct('is_pixel_aligned', true, 'alignment_type', 'native_pixel_aligned') AS alignment")
    return detection.compare_rasters(pairs, rasters.drop("t"), detection.ChangeConfig(bands=("B1", "B2"), side=TILE_SIDE), false_alarms.SuppressionConfig(sensitivity_k=1.0, min_valid_pixels=10))


@query(
    TILES
    + f"""SELECT pair_id, 'success' AS status, valid_pixels, {r6("mean")} AS mean, {r6("median")} AS median, {r6("p95")} AS p95, {r6("max")} AS max, {r6("std")} AS std, {r6("used")} AS threshold_used, {r6("noise_median")} AS noise_median, {r6("noise_mad")} AS noise_mad,
coalesce(candidate_pixels, 0) AS candidate_pixels, coalesce(confirmed_pixels, 0) AS confirmed_pixels, {r6("mean_confidence")} AS mean_confidence, {r6("max_confidence")} AS max_confidence
FROM seen JOIN t USING (pair_id) LEFT JOIN counted USING (pair_id) LEFT JOIN confirmed USING (pair_id)"""
)
def change_and_suppress(spark, sf_dir):
    """Change detection and suppression of pairs of tiles, from rasters to confirmed pixels, in one kernel a pair."""
    out = _compared_tiles(spark, sf_dir).select("pair_id", "suppressed.status", F.col("suppressed.valid_pixels").alias("valid_pixels"), *(F.col(f"summary.{c}") for c in ("mean", "median", "p95", "max", "std")), *(F.col(f"suppressed.{c}") for c in ("threshold_used", "noise_median", "noise_mad", "candidate_pixels", "confirmed_pixels", "mean_confidence", "max_confidence")))
    return rounded(out, "mean", "median", "p95", "max", "std", "threshold_used", "noise_median", "noise_mad", "mean_confidence", "max_confidence")


@query(TILES + f"SELECT pair_id, r, c, component, area, {r6('confidence')} AS confidence FROM sure")
def confirmed_changes(spark, sf_dir):
    """The confirmed pixels of the same."""
    found = _compared_tiles(spark, sf_dir).select("pair_id", F.inline("suppressed.pixels")).where("area IS NOT NULL")
    return rounded(found.select("pair_id", "r", "c", "component", "area", "confidence"), "confidence")


@query(
    f"""WITH scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {EXACT} AS score, e.label = q.label AS same FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
SELECT query_id, count(*) FILTER (same) AS n_same, sum(id)::BIGINT AS id_sum, {r6("min(score)")} AS least FROM ranked WHERE rank <= 5 GROUP BY 1"""
)
def nearest_of_each(spark, sf_dir):
    """The five nearest of every row among all rows, both sides in blocks on the executors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = search.search_all(rows.select("id", "embedding"), rows.select("id", "embedding"), 5, block=200)
    named = near.join(rows.select("id", "label"), "id").join(rows.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    out = named.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("n_same"), F.sum("id").alias("id_sum"), F.min("score").alias("least"))
    return out


@query(
    f"""WITH goal AS (SELECT vec_id AS q, (SELECT min(vec_id) FROM embeddings o WHERE o.label = e.label) AS t, embedding, label FROM embeddings e),
wanted AS (SELECT q, t, goal.embedding, floor(list_inner_product(goal.embedding::DOUBLE[], x.embedding::DOUBLE[]) * 1e12 + 0.5) / 1e12 AS s FROM goal JOIN embeddings x ON x.vec_id = t)
SELECT q.q AS query_id, 1 + count(*) FILTER ({EXACT} > q.s OR ({EXACT} = q.s AND e.vec_id < q.t)) AS rank FROM wanted q JOIN embeddings e ON TRUE GROUP BY 1"""
)
def target_ranks(spark, sf_dir):
    """The rank that the first row of each row's label has among all rows for it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    first = rows.groupBy("label").agg(F.min("id").alias("target_id"))
    goals = first.join(rows.select(F.col("id").alias("target_id"), F.col("embedding").alias("target_embedding")), "target_id")
    return search.target_ranks(rows.join(goals, "label").select("id", "embedding", "target_id", "target_embedding"), rows.select("id", "embedding"), block=200)


FOOT = """SELECT p_partkey AS id, p_size AS day, p_size + (p_partkey % 100) / 100.0::DOUBLE AS west, p_retailprice / 100 AS south,
p_size + (p_partkey % 100) / 100.0::DOUBLE + 0.05::DOUBLE * (1 + p_partkey % 7) AS east, p_retailprice / 100 + CASE WHEN p_partkey % 500 = 0 THEN 5 ELSE 0.06 END::DOUBLE AS north FROM part"""


@query(
    f"""WITH b AS ({FOOT}), j AS (SELECT x.id AS reference_id, y.id AS comparison_id, least(x.east, y.east) - greatest(x.west, y.west) AS w, least(x.north, y.north) - greatest(x.south, y.south) AS h,
(x.east - x.west) * (x.north - x.south) AS ax, (y.east - y.west) * (y.north - y.south) AS ay
FROM b x JOIN b y ON x.day < y.day AND x.west <= y.east AND y.west <= x.east AND x.south <= y.north AND y.south <= x.north)
SELECT reference_id, comparison_id, {r6("w * h / (ax + ay - w * h)")} AS iou FROM j WHERE w > 0 AND h > 0"""
)
def footprint_pairs(spark, sf_dir):
    """Pairs of boxes of different days that share some area, found by cells of a plane."""
    boxes = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_size AS acquired", "p_size + (p_partkey % 100) / 100D AS west", "p_retailprice / 100D AS south",
        "p_size + (p_partkey % 100) / 100D + 0.05D * (1 + p_partkey % 7) AS east", "p_retailprice / 100D + IF(p_partkey % 500 = 0, 5D, 0.06D) AS north",
    )
    return rounded(footprints.overlapping_pairs(boxes), "iou")


@query(
    """SELECT CASE WHEN label < 5 THEN 'optical' ELSE 'sar' END AS modality, count(*) AS n, sum(vec_id)::BIGINT AS id_sum, 2 AS n_parts FROM embeddings GROUP BY 1"""
)
def index_by_parts(spark, sf_dir):
    """An index that is written as two parts and read back by its manifest."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("concat('t', vec_id) AS tile_id", "vec_id", "IF(label < 5, 'optical', 'sar') AS modality", "embedding")
    path = f"{shared_folder(spark).rstrip('/')}/terraquarry-core/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    parts.create(spark, path, 64)
    for half in (0, 1):
        parts.append(path, rows.where(f"vec_id % 2 = {half}"))
    found = parts.manifest(spark, path)
    return parts.load(spark, path, verify=True).groupBy("modality").agg(F.count("*").alias("n"), F.sum("vec_id").alias("id_sum")).withColumn("n_parts", F.lit(len(found.parts)))


TILE_ROWS = """SELECT 't' || event_id AS tile_id, 's' || (event_id % 40) AS scene_id, CASE WHEN event_type = 'view' THEN 'sar' ELSE 'optical' END AS modality, ts, user_id::INT AS row_idx, ascii(event_type) AS col_idx,
(event_id % 50)::DOUBLE AS west, (event_id % 20)::DOUBLE AS south, v.embedding FROM embeddings v LEFT JOIN events ON event_id = vec_id"""


def _index(spark, sf_dir):
    """Vectors with the metadata of the event of the same number, as an index."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("concat('t', vec_id) AS tile_id", "vec_id", "embedding")
    events = table(spark, sf_dir, "events").selectExpr("event_id", "concat('s', event_id % 40) AS scene_id", "IF(event_type = 'view', 'sar', 'optical') AS modality")
    known = vectors.join(events, F.col("vec_id") == F.col("event_id"), "left").select("tile_id", "scene_id", "modality", "embedding")
    tiles = table(spark, sf_dir, "events").selectExpr(
        "concat('t', event_id) AS tile_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS acquisition_datetime_utc", "CAST(user_id AS INT) AS row_idx", "ascii(event_type) AS col_idx",
        "array(CAST(event_id % 50 AS DOUBLE), CAST(event_id % 20 AS DOUBLE), event_id % 50 + 1D, event_id % 20 + 1D) AS bounds_wgs84",
    )
    return index.checked(index.index_entries(known, tiles), 64)


@query(f"SELECT tile_id, row_number() OVER (ORDER BY coalesce(modality = 'optical', false), modality NULLS FIRST, scene_id NULLS FIRST, row_idx, col_idx, tile_id) - 1 AS row_id FROM ({TILE_ROWS})")
def index_row_ids(spark, sf_dir):
    """The position of every tile of a checked index."""
    return index.with_row_ids(_index(spark, sf_dir)).select("tile_id", "row_id")


LIKE = EXACT.replace("e.embedding", "i.embedding")


@query(f"SELECT row_number() OVER (ORDER BY s DESC, tile_id)::INT AS rank, tile_id, scene_id, {r6('s')} AS similarity_score FROM (SELECT i.*, {LIKE} AS s FROM ({TILE_ROWS}) i, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 10")
def like_tile(spark, sf_dir):
    """The ten tiles nearest to a stored one, itself among them."""
    return index.TextSearch(_index(spark, sf_dir), dimension=64).like_tile("t0", 10).select("rank", "tile_id", "scene_id", "similarity_score")


@query(
    f"""SELECT row_number() OVER (ORDER BY s DESC, tile_id)::INT AS rank, tile_id, modality, {r6('s')} AS similarity_score FROM (SELECT i.*, {LIKE} AS s FROM ({TILE_ROWS}) i, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE modality = 'optical' AND scene_id = 's7' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-12-30 23:59:59.999999' AND west <= 47 AND west + 1 >= 2 AND south <= 12 AND south + 1 >= 3) QUALIFY rank <= 10"""
)
def tile_search(spark, sf_dir):
    """Search by a vector with filters of modality, scene, dates and a box."""
    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    found = index.TextSearch(_index(spark, sf_dir), dimension=64)
    if first is None:
        raise ValueError("embeddings has no row 0")
    import numpy as np

    return found.search(np.array(first[0], np.float32), 10, "optical", "2024-01-02", "2024-12-30", "s7", [2.0, 3.0, 47.0, 12.0]).select("rank", "tile_id", "modality", "similarity_score")


@query("SELECT count(*) AS total_tiles, count(DISTINCT event_id) AS total_scenes FROM events")
def index_totals(spark, sf_dir):
    return pairing.totals(_tile_index(spark, sf_dir))


WINDOWS = """WITH d AS (SELECT p_partkey AS scene_id, (p_size * 40 + 100)::BIGINT AS w FROM part),
o AS (SELECT scene_id, w, CASE WHEN w <= 256 THEN [0::BIGINT] ELSE list_sort(list_distinct(list_concat(range(0, w - 255, 256), [w - 256]))) END AS offs FROM d),
t AS (SELECT a.scene_id, i - 1 AS row_idx, j - 1 AS col_idx, a.offs[i] AS row_off, a.offs[j] AS col_off, least(256, w - a.offs[j]) AS width, least(256, w - a.offs[i]) AS height
FROM o a, unnest(range(1, len(offs) + 1)) AS x(i), unnest(range(1, len(offs) + 1)) AS y(j))"""


@query(
    WINDOWS
    + """SELECT printf('s2_%s_10m_r%02d_c%02d', scene_id::VARCHAR, row_idx, col_idx) AS tile_id, printf('s1_%s_radar_r%02d_c%02d', scene_id::VARCHAR, row_idx, col_idx) AS radar_id, col_off // 2 AS half_col_off, row_off // 2 AS half_row_off, width // 2 AS half_width, height // 2 AS half_height,
1000 + col_off AS abs_col_off, scene_id + row_off AS abs_row_off, 300000.0::DOUBLE + 10 * col_off AS west, 2100000.0::DOUBLE - 10 * row_off AS north, 300000.0::DOUBLE + 10 * (col_off + width) AS east, 2100000.0::DOUBLE - 10 * (row_off + height) AS south FROM t"""
)
def tile_geometry(spark, sf_dir):
    """Names, half-resolution windows, absolute places, transforms and bounds of all tiles."""
    tiles = tiling.absolute_window(tiling.half_window(tiling.tile_windows(_sides(spark, sf_dir))), F.lit(1000).cast("long"), F.col("scene_id"))
    affine = F.array(*map(F.lit, (10.0, 0.0, 300000.0, 0.0, -10.0, 2100000.0)))
    moved = tiles.withColumn("affine", tiling.tile_affine(affine, F.col("col_off"), F.col("row_off")))
    box = tiling.projected_bounds(F.col("affine"), F.col("width"), F.col("height"))
    named = [f(F.col("scene_id").cast("string"), F.col("row_idx"), F.col("col_idx")).alias(n) for f, n in ((tiling.optical_tile_id, "tile_id"), (tiling.radar_tile_id, "radar_id"))]
    return moved.select(*named, *(f"half_{c}" for c in ("col_off", "row_off", "width", "height")), "abs_col_off", "abs_row_off", *(box[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))))


@query(WINDOWS + "SELECT scene_id, count(*) AS total_tiles, (max(row_idx) + 1)::INT AS grid_rows, (max(col_idx) + 1)::INT AS grid_cols, sum(width * height)::BIGINT AS total_bytes FROM t GROUP BY 1")
def tile_manifests(spark, sf_dir):
    """The manifest of each scene's tiles (its list of tiles left out)."""
    tiles = tiling.tile_windows(_sides(spark, sf_dir)).withColumn("size", F.col("width") * F.col("height"))
    named = tiles.withColumn("tile_id", tiling.optical_tile_id(F.col("scene_id").cast("string"), F.col("row_idx"), F.col("col_idx")))
    return tiling.manifests(named, "size").drop("tiles")


@query("SELECT CASE WHEN lang = 'en' THEN 'optical' ELSE 'sar' END AS modality, source AS scene_id, count(*) AS total_tiles, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY ROLLUP (modality, scene_id)")
def tiling_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("IF(lang = 'en', 'optical', 'sar') AS modality", "source AS scene_id", "n_chars")
    return tiling.tiling_summary(rows, "n_chars")


@query(f"SELECT pair_id, r - 3 AS r, c - 25 AS c, magnitude FROM ({RASTER}) WHERE r BETWEEN 3 AND 62 AND c BETWEEN 25 AND 64")
def window_crop(spark, sf_dir):
    """A window of each raster, moved to its origin."""
    pixels = _raster(spark, sf_dir).select("pair_id", "r", "c", "magnitude")
    windows = pixels.select("pair_id").distinct().selectExpr("pair_id", "3 AS row_off", "25 AS col_off", "40 AS width", "60 AS height")
    return tiling.crop_pixels(pixels, windows, ["pair_id"]).select("pair_id", "r", "c", "magnitude")


@query("SELECT lang || '_' || doc_id || '.tif' AS image_id, 'images/' || lang || '_' || doc_id || '.tif' AS relative_path, lower(lang) AS category, sha256(text) AS sha256, lang || '_' || doc_id || '.tif_cap_1' AS second_caption, trim(source) AS text FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def manifest_items(spark, sf_dir):
    """Images and captions of a benchmark's table, of which documents make one with two captions each."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    split = rows.selectExpr("concat('some/', lang, '_', doc_id, '.tif') AS filename", "CAST(text AS BINARY) AS image", "array('a caption', concat(' ', source, ' ')) AS captions")
    images, captions = evaluation.items_of(split)
    second = captions.where("caption_id LIKE '%cap_1'").select("image_id", F.col("caption_id").alias("second_caption"), "text")
    return images.select("image_id", "relative_path", "category", "sha256").join(second, "image_id")


@query("SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS n_files, (SELECT count(DISTINCT doc_id) FROM documents) AS n_items, (SELECT count(DISTINCT doc_id) FROM documents JOIN labels USING (doc_id)) AS n_both, false AS complete")
def name_overlap(spark, sf_dir):
    """What names of files and of items share."""
    return evaluation.overlap(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id")))


_SUMS = "count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS my, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy"


@query(
    f"""WITH s AS (SELECT l_suppkey, {_SUMS}, avg(l_tax) AS mz, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_discount, l_tax) AS yz FROM lineitem GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM s)
SELECT l_suppkey, {r6("a")} AS a, {r6("b")} AS b, {r6("mz - a * mx - b * my")} AS c FROM f"""
)
def gcp_fits(spark, sf_dir):
    """The affine fit of each scene's control points (here: of a supplier's line items), from an array a scene."""
    point = F.struct(F.col("l_quantity").alias("local_col"), F.col("l_discount").alias("local_row"), F.col("l_tax").alias("lon"), F.col("l_tax").alias("lat"))
    scenes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(point).alias("g")).where(F.size("g") >= 20)
    fit = scenes.select("l_suppkey", tiling.local_affine(F.col("g")).alias("fit"))
    return rounded(fit.select("l_suppkey", *(F.col("fit.coefficients")[i].alias(n) for i, n in enumerate("abc"))), "a", "b", "c")


@query(
    f"""WITH v AS (SELECT event_id // {_CELLS} AS t, count(*) AS n, min(value) AS low FROM events GROUP BY 1 HAVING count(*) = {_CELLS}),
p AS (SELECT a.t // 2 AS pair_id FROM v a JOIN v b ON b.t = a.t + 1 WHERE a.t % 2 = 0)
SELECT pair_id, CASE pair_id % 7 WHEN 1 THEN 'crs_mismatch' WHEN 2 THEN 'transform_mismatch' WHEN 3 THEN 'missing_raster_file' WHEN 4 THEN 'unsupported_sar_unaligned' WHEN 5 THEN 'unaligned_optical_grid' WHEN 6 THEN 'dimension_mismatch' ELSE 'success' END AS status,
CASE WHEN pair_id % 7 = 0 THEN 'adaptive_mad_suppression' ELSE 'unsupported' END AS method FROM p"""
)
def change_statuses(spark, sf_dir):
    """What becomes of pairs whose headers, files, modality or grids do not fit, as the number of the pair has it."""
    rasters = _tile_rasters(spark, sf_dir)
    pair, odd = F.expr("t div 2 % 7"), F.expr("t % 2 = 1")
    wrong = rasters.where(~(odd & (pair == 3) & (F.col("band") == "B2")))
    wrong = wrong.withColumns({
        "crs": F.when(odd & (pair == 1), "EPSG:1").otherwise(F.col("crs")), "height": F.when(odd & (pair == 6), 8).otherwise(F.col("height")),
        "affine": F.when(odd & (pair == 2), F.transform("affine", lambda x, i: F.when(i == 2, 5.0).otherwise(x))).otherwise(F.col("affine")),
    })
    tiles = rasters.where("band = 'B1'").select("t")
    pairs = tiles.where("t % 2 = 0").join(tiles.select((F.col("t") - 1).alias("t")), "t").selectExpr(
        "t div 2 AS pair_id", "concat('t', t) AS reference_tile_id", "concat('t', t + 1) AS comparison_tile_id", "IF(t div 2 % 7 = 4, 'sar', 'optical') AS modality",
        "named_struct('is_pixel_aligned', t div 2 % 7 <> 5, 'alignment_type', 'any') AS alignment",
    )
    found = detection.compare_rasters(pairs, wrong.drop("t"), detection.ChangeConfig(bands=("B1", "B2"), side=TILE_SIDE), false_alarms.SuppressionConfig(min_valid_pixels=10))
    return found.select("pair_id", "status", F.col("suppressed.method").alias("method"))


RANKED = """WITH img AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 2 = 0), cap AS (SELECT vec_id, vec_id - 1 AS own, embedding FROM embeddings WHERE vec_id % 2 = 1),
t AS (SELECT q.vec_id AS q, q.own, e.vec_id AS id, e.label, floor(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 1e12 + 0.5) / 1e12 AS s FROM cap q, img e),
tr AS (SELECT t.*, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank, label = (SELECT label FROM img WHERE vec_id = t.own) AS rel FROM t),
c AS (SELECT q.vec_id AS q, e.vec_id AS id, q.label = e.label AS rel, floor(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 1e12 + 0.5) / 1e12 AS s FROM img q JOIN img e ON q.vec_id <> e.vec_id),
cr AS (SELECT c.*, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM c),
inst AS (SELECT rank FROM tr WHERE id = own),
"""


def _task(ranked: str, name: str, depth: int) -> str:
    return f"""{name}_n AS (SELECT q, count(*) FILTER (rel) AS n FROM {ranked} GROUP BY 1),
{name}_h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rank) AS hits FROM {ranked} WHERE rank <= {depth}),
{name} AS (SELECT n.q, any_value(n) AS n, sum(rel::INT) FILTER (rank <= 1) AS h1, sum(rel::INT) FILTER (rank <= 5) AS h5, sum(rel::INT) FILTER (rank <= 10) AS h10, sum(rel::INT) FILTER (rank <= 20) AS h20,
  sum(CASE WHEN rel THEN hits / rank ELSE 0 END) AS ap, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM {name}_n n JOIN {name}_h h ON n.q = h.q GROUP BY 1)"""


def _r4(sql: str) -> str:
    return f"round({sql}, 4)"


@query(
    RANKED + _task("tr", "cat", 20) + "," + _task("cr", "cls", 50)
    + "".join(
        f" {'UNION ALL ' if i else ''}SELECT '{task}' AS task, '{measure}' AS measure, {_r4(value)} AS value FROM {source}"
        for i, (task, source, measure, value) in enumerate(
            [("text_to_image_instance", "inst", f"Recall@{k}", f"avg((rank <= {k})::INT)") for k in (1, 5, 10)] + [("text_to_image_instance", "inst", "MRR", "avg(1.0::DOUBLE / rank)")]
            + [("text_to_image_category", "cat", f"Recall@{k}", f"avg(h{k} / greatest(n, 1))") for k in (5, 10, 20)]
            + [("text_to_image_category", "cat", "mAP@20", "avg(CASE WHEN n > 0 THEN ap / least(n, 20) END)")]
            + [("text_to_image_category", "cat", "nDCG@20", "avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 20)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END)")]
            + [("image_to_image_class", "cls", "Recall@10", "avg(h10 / greatest(n, 1))")] + [("image_to_image_class", "cls", f"Precision@{k}", f"avg(h{k} / {k}.0::DOUBLE)") for k in (1, 5, 10)]
            + [("image_to_image_class", "cls", "mAP@50", "avg(CASE WHEN n > 0 THEN ap / least(n, 50) END)")]
        )
    )
)
def evaluate_retrieval(spark, sf_dir):
    """Fourteen measures of three tasks: even vectors are images of their label, odd ones captions of the image before."""
    rows = table(spark, sf_dir, "embeddings")
    images = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("category"))
    captions = rows.where("vec_id % 2 = 1").selectExpr("vec_id AS caption_id", "vec_id - 1 AS image_id")
    vectors = [rows.where(f"vec_id % 2 = {k}").select(F.col("vec_id").alias("id"), "embedding") for k in (0, 1)]
    return evaluation.evaluate(images, captions, *vectors)
