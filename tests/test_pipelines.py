import numpy as np
from pyspark.sql import functions as F

from orthospark.plans import pipelines as P

from test_tiles import array, grid


def test_green_mask(spark):
    a = np.zeros((24, 24), int)
    a[4:16, 4:16] = 1
    a[9, 9] = 0
    image = grid(spark, a.tolist(), kind="int").select("raster_id", "y", "x", F.lit(10).alias("r"), F.when(F.col("v") == 1, 200).otherwise(10).alias("g"), F.lit(10).alias("b"))
    p = P.GreenMask(kernel=1, close_sizes=(3,), buffer=1, border=1, bridge_width=3, bridge_depth=1, least_covered=0.3, kernel_step=2)
    mask = array(P.segment_green(image, p))
    assert set(np.unique(mask)) == {0, -999} and (mask[3:17, 3:17] == -999).all() and (mask == -999).sum() == 14 * 14


def test_candidate_mask(spark):
    image = grid(spark, np.full((8, 8), 200.0).tolist())
    seg = spark.createDataFrame([("r", 1, y, x) for y in range(8) for x in range(4)], "raster_id string, seg_id int, y int, x int")
    full = grid(spark, np.random.default_rng(0).random((16, 16)).tolist())
    mask = array(P.segment_candidates(image, seg, full.withColumn("b", F.lit(0)), full.select("raster_id", "y", "x", F.lit(False).alias("nodata")), 16, 16, 0.1, 0.5, 0.5, 3, 1))
    assert (mask[:, :6] == -999).all() and (mask[:, 6:] == 0).all()


def test_training_tiles(spark):
    rng = np.random.default_rng(1)
    cells = grid(spark, rng.random((16, 16)).tolist()).withColumn("b", F.lit(0))
    kind = np.full((16, 16), -999)
    kind[:4, :4] = 1
    kind[5, 5] = 0
    mask = grid(spark, kind.tolist(), kind="int").withColumnRenamed("v", "mask")
    ref = grid(spark, np.zeros((16, 16)).tolist()).withColumnRenamed("v", "ref")
    split, scaled = P.training_tiles(cells, mask, ref, 16, 16, 4, 0, 0.8, "s")
    n = {(r.case, r.split): r["count"] for r in split.groupBy("case", "split").count().collect()}
    assert n == {("case_1", "test"): 1, ("normal", "test"): 1, ("normal", "train"): 13}
    assert scaled.count() == 15 * 16 and scaled.agg(F.min("v"), F.max("v")).first()[:] == (0.0, 1.0)
