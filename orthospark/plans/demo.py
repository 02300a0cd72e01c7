"""The supplied tables read as tiles, rasters, scores and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 tiles of one band, of five sites, with cases by the id."""
    case = F.when(F.col("vec_id") % 8 == 0, "case_1").when(F.col("vec_id") % 8 == 1, "case_2").when(F.col("vec_id") % 8 == 2, "case_3").otherwise("normal")
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile_id"), F.concat(F.lit("site_"), F.col("label") % 5).alias("orchard"), case.alias("case"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"),
        F.col("embedding").cast("array<double>").alias("data"),
    )


def raster(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """Line items as dense rasters, one a return flag and 15,000 orders: the quantity sold at each (order, part) place."""
    site = F.concat_ws("_", "l_returnflag", F.floor(F.col("l_orderkey") / 15_000).cast("string"))
    items = _table(spark, sf_dir, "lineitem").select(site.alias("raster_id"), (F.col("l_orderkey") % size).cast("int").alias("y"), (F.col("l_partkey") % size).cast("int").alias("x"), F.col("l_quantity").alias("q"))
    sums = items.groupBy("raster_id", "y", "x").agg(F.sum("q").alias("q"))
    grid = items.select("raster_id").distinct().select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("y")).select("raster_id", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x"))
    return grid.join(sums, ["raster_id", "y", "x"], "left").select("raster_id", "y", "x", F.coalesce("q", F.lit(0.0)).alias("v"))


def mask(spark: SparkSession, sf_dir: str, size: int = 64, times: int = 1) -> DataFrame:
    """The raster as 0/1: places whose quantity is above so many times the mean of its raster."""
    cells = raster(spark, sf_dir, size)
    mean = cells.groupBy("raster_id").agg(F.round(F.avg("v"), 6).alias("__mean"))
    return cells.join(mean, "raster_id").select("raster_id", "y", "x", F.when(F.col("v") > times * F.col("__mean"), 1).otherwise(0).alias("v"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scores: class is the type, label the user's parity."""
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("clsname"), F.col("event_id").alias("tile_id"), (F.col("user_id") % 2).cast("int").alias("label"), F.round("value", 3).alias("score"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day as training logs: one model a type, two areas from the day's values."""
    day = F.dayofyear("ts")
    by = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), day.alias("epoch"))
    return by.agg((F.round(F.avg("value"), 6) / 1000).alias("auroc_1"), (F.round(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 6) / 1000).alias("auroc_2"), F.count("*").alias("n"))


TILES_SQL = """tiles AS (SELECT vec_id AS tile_id, 'site_' || (label % 5) AS orchard,
  CASE vec_id % 8 WHEN 0 THEN 'case_1' WHEN 1 THEN 'case_2' WHEN 2 THEN 'case_3' ELSE 'normal' END AS case_, embedding FROM embeddings),
cells AS (SELECT tile_id, orchard, case_, (p - 1) // 8 AS y, (p - 1) % 8 AS x, v FROM (
  SELECT tile_id, orchard, case_, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM tiles))"""

RASTER_SQL = """items AS (SELECT l_returnflag || '_' || (l_orderkey // 15000) AS raster_id, (l_orderkey % 64)::INT AS y, (l_partkey % 64)::INT AS x, l_quantity AS q FROM lineitem),
raster AS (SELECT g.raster_id, g.y, g.x, coalesce(s.q, 0.0) AS v FROM
  (SELECT r.raster_id, a.i::INT AS y, b.i::INT AS x FROM (SELECT DISTINCT raster_id FROM items) r, range(64) a(i), range(64) b(i)) g
  LEFT JOIN (SELECT raster_id, y, x, sum(q) AS q FROM items GROUP BY ALL) s USING (raster_id, y, x))"""

MASK_SQL = RASTER_SQL + """,
mask AS (SELECT raster_id, y, x, CASE WHEN v > m THEN 1 ELSE 0 END AS v FROM raster JOIN (SELECT raster_id, round(avg(v), 6) AS m FROM raster GROUP BY raster_id) USING (raster_id))"""

SCORES_SQL = "scores AS (SELECT event_type AS clsname, event_id AS tile_id, (user_id % 2)::INT AS label, round(value, 3) AS score FROM events)"

RUNS_SQL = """runs AS (SELECT event_type AS model, dayofyear(ts)::INT AS epoch, round(avg(value), 6) / 1000 AS auroc_1,
  round(avg(CASE WHEN user_id % 2 = 0 THEN value END), 6) / 1000 AS auroc_2, count(*) AS n FROM events GROUP BY ALL)"""
