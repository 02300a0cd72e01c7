"""Registered queries that write files of the supplied tables and read them back, and the SQL each must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthospark.functions import columns as C
from orthospark.operators import metadata as D
from orthospark.operators import scoring
from orthospark.operators import tiles as T
from orthospark.plans import demo
from orthospark.plans.demo import MASK_SQL, RUNS_SQL, SCORES_SQL, TILES_SQL
from orthospark.plans.demo_queries import JUDGED_SQL, SEED, SPLIT_SQL, TEST_SQL, limits_of, query, rounded
from orthospark.sources import npy as NPY
from orthospark.sources import tables as S
from orthospark.sources.scratch import shared_dir, written


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.train_test_split(demo.tiles(spark, sf_dir), "tile_id", SEED)


@query("WITH " + TEST_SQL + """ SELECT 'train' AS split, tile_id::VARCHAR AS filename, 0 AS label, 'good' AS label_name, orchard AS clsname, case_ AS "case" FROM split WHERE split = 'train' AND case_ = 'normal'
  UNION ALL SELECT 'test', m.tile_id::VARCHAR, m.label, CASE m.label WHEN 0 THEN 'good' ELSE 'defective' END, m.clsname, t.case_ FROM meta m JOIN tiles t ON t.tile_id = m.tile_id""")
def metadata_files(spark, sf_dir):
    split = _split(spark, sf_dir).select("tile_id", "orchard", "case", "split")
    test = D.build_test_metadata(split, "tile_id", SEED).select("tile_id", "clsname", "label", "case").withColumn("split", F.lit("test"))
    train = D.build_train_metadata(split).select("tile_id", "clsname", "label", "case", "split")
    rows = train.unionByName(test).select(
        F.col("tile_id").cast("string").alias("filename"), "label", F.when(F.col("label") == 0, "good").otherwise("defective").alias("label_name"), "clsname",
        F.array(F.lit(0.5)).alias("mean"), F.array(F.lit(0.25)).alias("std"), "case", F.lit(None).cast("string").alias("maskname"), "split",
    )
    root = _folder(spark, "metadata")
    S.write_metadata(rows, root)
    back = [S.read_metadata(spark, f"{root}/{name}_metadata").withColumn("split", F.lit(name)) for name in ("train", "test")]
    return back[0].unionByName(back[1]).select("split", "filename", "label", "label_name", "clsname", "case")


@query("WITH " + SCORES_SQL + " SELECT clsname || '_' || (tile_id % 7) || '_' || tile_id AS result_key, round(CASE WHEN tile_id % 2 = 0 THEN score + 1 ELSE score END, 3) AS pred FROM scores")
def result_files(spark, sf_dir):
    """Every second tile is scored twice; the later score counts."""
    path = F.concat(F.lit("root/site/test/"), F.col("tile_id") % 7, F.lit("/"), F.col("tile_id"), F.lit(".npy"))
    once = demo.scores(spark, sf_dir).select("clsname", path.alias("filename"), F.lit(1).alias("at"), F.col("score").alias("pred"), "tile_id")
    again = once.where("tile_id % 2 = 0").withColumn("at", F.lit(2)).withColumn("pred", F.col("pred") + 1)
    root = _folder(spark, "results")
    S.write_results(once.unionByName(again).drop("tile_id"), root, "at")
    return rounded(S.read_results(spark, root), "pred", places=3).select("result_key", "pred")


@query("WITH " + SCORES_SQL + """, rows_ AS (SELECT clsname, tile_id, score + 100 AS pred, 3 AS ran FROM scores WHERE clsname <= 'purchase' AND tile_id % 3 = 0 UNION ALL SELECT clsname, tile_id, score, 2 FROM scores WHERE tile_id % 5 > 0
  UNION ALL SELECT clsname, tile_id, score - 100, 1 FROM scores WHERE clsname <= 'purchase')
SELECT clsname, clsname || '_r_' || tile_id AS result_key, round(arg_max(pred, ran), 3) AS pred FROM rows_ GROUP BY clsname, tile_id""")
def merged_results(spark, sf_dir):
    """Three runs into one table: a first one without every fifth tile, a later one of some classes, and one that comes last but is the oldest."""
    path = F.concat(F.lit("root/site/r/"), F.col("tile_id"), F.lit(".npy"))
    of = lambda rows, at, by: rows.select("clsname", path.alias("filename"), F.lit(at).alias("at"), (F.col("score") + by).alias("pred"))
    scores, root = demo.scores(spark, sf_dir), _folder(spark, "results")
    some = scores.where("clsname <= 'purchase'")
    for run in (of(scores.where("tile_id % 5 > 0"), 2, 0), of(some.where("tile_id % 3 = 0"), 3, 100), of(some, 1, -100)):
        S.write_results(run, root, "at")
    return rounded(S.read_results(spark, root), "pred", places=3).select("clsname", "result_key", "pred")


def _npy(spark, sf_dir) -> str:
    """Tiles as .npy files, a third of them in the test folder."""
    split = F.when(F.col("tile_id") % 3 == 0, "test").otherwise("train")
    root = _folder(spark, "npy")
    root = root if "://" in root else f"file://{root}"
    NPY.write_tiles(demo.tiles(spark, sf_dir).select("orchard", split.alias("split"), "case", F.format_string("%d.npy", "tile_id").alias("name"), "height", "width", "channels", "data"), root)
    return root


@query("WITH " + TILES_SQL + """ SELECT orchard, case_ AS "case", tile_id || '.npy' AS name, count(*) AS n, round(sum(v * (y * 8 + x)), 3) AS digest FROM cells WHERE tile_id % 3 = 0 GROUP BY ALL""")
def npy_tiles(spark, sf_dir):
    """Written, and the test folders read back."""
    digest = F.aggregate(F.transform("data", lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    return NPY.read_tiles(spark, _npy(spark, sf_dir)).where("split = 'test'").select("orchard", "case", "name", F.size("data").cast("long").alias("n"), F.round(digest, 3).alias("digest"))


@query("WITH " + TILES_SQL + """ SELECT orchard || '_' || CASE WHEN tile_id % 3 = 0 THEN 'test' ELSE 'train' END || '_' || case_ || '_' || tile_id || '_npy' AS unique_id FROM tiles""")
def list_inputs(spark, sf_dir):
    return S.list_inputs(spark, _npy(spark, sf_dir), "*.npy").select("unique_id")


@query("WITH " + MASK_SQL + " SELECT raster_id, y, x, m.v AS mask, CASE WHEN r.v > 2000 THEN -32767.0 ELSE 0.0 END AS ref, r.v FROM mask m JOIN raster r USING (raster_id, y, x)")
def bucketed_layers(spark, sf_dir):
    """Layers as bucketed tables, which meet without a shuffle."""
    cells = demo.raster(spark, sf_dir)
    layers = {"data": cells, "mask": demo.mask(spark, sf_dir).withColumnRenamed("v", "mask"), "ref": cells.select("raster_id", "y", "x", F.when(F.col("v") > 2000, -32767.0).otherwise(0.0).alias("ref"))}
    named = {name: f"{name}_{uuid.uuid4().hex}" for name in layers}
    for name, layer in layers.items():
        S.write_layer(layer, named[name], 8, _folder(spark, name))
    return T.colocate(*[spark.table(named[name]) for name in layers])


@query("WITH " + TILES_SQL + " SELECT orchard, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cells GROUP BY orchard")
def stats_files(spark, sf_dir):
    root = _folder(spark, "stats")
    S.write_stats(T.channel_stats(T.tiles_to_cells(demo.tiles(spark, sf_dir), "orchard")), root)
    return rounded(S.read_stats(spark, root), "mean", "std").select("orchard", "mean", "std")


@query("WITH " + JUDGED_SQL + " SELECT 'all_case_1' AS clsname, lower_ AS threshold FROM limits UNION ALL SELECT 'all_case_2', upper_ FROM limits")
def threshold_files(spark, sf_dir):
    root = _folder(spark, "thresholds")
    S.write_thresholds(limits_of(spark, sf_dir), root)
    return S.read_thresholds(spark, root).select("clsname", "threshold")


@query("WITH " + SPLIT_SQL + ', sums AS (SELECT tile_id, round(sum(v), 4) AS total FROM cells GROUP BY tile_id) SELECT tile_id, orchard, split, case_ AS "case", total FROM split JOIN sums USING (tile_id)')
def dataset_files(spark, sf_dir):
    root = _folder(spark, "dataset")
    S.write_dataset(_split(spark, sf_dir), root)
    total = F.round(F.aggregate("data", F.lit(0.0), lambda s, v: s + v), 4)
    return S.read_dataset(spark, root).select("tile_id", "orchard", "split", "case", total.alias("total"))


@query("WITH " + RUNS_SQL + " SELECT 'daily' AS name, 'events' AS experiment, epoch, round(auroc_1, 9) AS auroc_1, round(auroc_2, 9) AS auroc_2 FROM runs")
def run_logs(spark, sf_dir):
    root = _folder(spark, "logs")
    rows = demo.runs(spark, sf_dir).select(F.col("epoch").alias("Epoch"), F.lit(0.0).alias("Train_Loss"), F.col("auroc_1").alias("all_case_1_AUROC"), F.col("auroc_2").alias("all_case_2_AUROC"))
    rows.write.option("header", True).csv(f"{root}/events")
    logs = S.read_runs(spark, root)
    # A log's stem is the writer's choice; the catalogue names whatever there is.
    catalogue = written(logs.select("experiment", "model").distinct().select(F.lit("daily").alias("name"), F.upper("experiment").alias("experiment"), "model"), "catalogue")
    named, _ = S.read_named_runs(logs, catalogue, ignore_case=True)
    return rounded(named.select("name", "experiment", "epoch", "auroc_1", "auroc_2"), "auroc_1", "auroc_2", places=9)


@query("WITH " + TILES_SQL + ", sites AS (SELECT orchard, count(*) AS n FROM tiles GROUP BY orchard) SELECT orchard, layer, '/data/' || orchard || '/' || layer AS file, (n / 1000)::DOUBLE AS chunk_size FROM sites, (VALUES ('image.tif'), ('mask.tif')) l(layer)")
def site_layers(spark, sf_dir):
    sites = demo.tiles(spark, sf_dir).groupBy("orchard").count().collect()  # a row a site: the parameters of a job
    fixed = {"output_path": "/out", "files": [("image.tif", 3)], "mask": "mask.tif", "reference": "ref.tif", "chunk_overlap": 0.5, "anomaly_threshold": 0.8, "scale_ratio": 1.0}
    given = S.projects(spark, [fixed | {"orchard": r.orchard, "path": f"/data/{r.orchard}", "chunk_size": r["count"] / 1000} for r in sites])
    return S.layers_for(given, ["image.tif", "mask.tif"]).select("orchard", "layer", "file", "chunk_size")


@query("SELECT l_orderkey, l_linenumber, l_linenumber = 1 AND l_discount = 0 AS nodata FROM lineitem")
def nodata_flag(spark, sf_dir):
    bands = F.array(F.col("l_linenumber").cast("double"), F.col("l_discount"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", C.is_nodata(bands, [1.0, 0.0]).alias("nodata"))


@query("WITH " + TILES_SQL + " SELECT tile_id, round(max(v) - min(v), 5) AS score FROM cells GROUP BY tile_id")
def score_tiles(spark, sf_dir):
    spread = lambda: lambda batch: batch.max(axis=1) - batch.min(axis=1)
    return rounded(scoring.score_tiles(demo.tiles(spark, sf_dir), spread, "tile_id"), "score", places=5)


@query("WITH " + TILES_SQL + """, normal AS (SELECT y, x, avg(v) AS m FROM cells WHERE case_ = 'normal' GROUP BY y, x)
SELECT tile_id, round(avg(CASE WHEN y < 2 THEN 0 ELSE (v - m) ** 2 END), 4) AS mse, round(sqrt(sum(CASE WHEN y < 2 THEN 0 ELSE (v - m) ** 2 END)), 4) AS distance FROM cells JOIN normal USING (y, x) GROUP BY tile_id""")
def rebuilt_tiles(spark, sf_dir):
    """Tiles rebuilt from the normal mean and their first two rows of cells, as fixed directions."""
    tiles = demo.tiles(spark, sf_dir)
    axes = [[float(i == k) for k in range(16)] for i in range(64)]
    rebuilt = scoring.project(tiles, scoring.mean_tile(tiles.where("case = 'normal'")), axes)
    return rounded(rebuilt.select("tile_id", "mse", "distance"), "mse", "distance", places=4)


@query("WITH " + TILES_SQL + " SELECT tile_id, round(avg(v), 5) AS mean, 0 AS moved FROM cells GROUP BY tile_id")
def feature_jitter(spark, sf_dir):
    """Tiles that the draw leaves alone, under a probability of nought, are as they were; under one of one each cell moves."""
    tiles = demo.tiles(spark, sf_dir)
    still, noisy = (C.jitter(F.col("data"), F.col("tile_id"), 20.0, p, 7) for p in (0.0, 1.0))
    same = F.aggregate(F.zip_with(noisy, "data", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    mean = F.aggregate(still, F.lit(0.0), lambda s, v: s + v) / F.size("data")
    return tiles.select("tile_id", F.round(mean, 5).alias("mean"), same.alias("moved"))
