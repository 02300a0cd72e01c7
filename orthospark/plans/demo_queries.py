"""Registered queries over the supplied tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthospark.functions import columns as C
from orthospark.operators import evaluate as E
from orthospark.operators import grids as G
from orthospark.operators import masks as M
from orthospark.operators import metadata as D
from orthospark.operators import tiles as T
from orthospark.operators import training as R
from orthospark.operators import windows as W
from orthospark.plans import demo
from orthospark.plans.demo import MASK_SQL, RASTER_SQL, RUNS_SQL, SCORES_SQL, TILES_SQL
from orthospark.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = "seed"
RASTER = ["raster_id"]


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# Scores of tiles: distance from the site's mean.
SCORED_SQL = TILES_SQL + """,
site AS (SELECT orchard, avg(v) AS mean FROM cells GROUP BY orchard),
scored AS (SELECT tile_id, orchard, case_, round(avg(abs(v - mean)) * 50, 4) AS score FROM cells JOIN site USING (orchard) GROUP BY ALL)"""


def scored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id", "orchard", "case")
    stats = T.channel_stats(cells).select("orchard", "b", F.col("mean").alias("__mean"))
    map_ = cells.join(stats, ["orchard", "b"]).withColumn("v", F.abs(F.col("v") - F.col("__mean")) * 50)
    return written(map_.groupBy("tile_id", "orchard", "case").agg(F.round(F.avg("v"), 4).alias("score")), "scored")


def _judged(scored: DataFrame) -> DataFrame:
    return E.apply_thresholds(scored, _limits(scored))


def _limits(scored: DataFrame) -> DataFrame:
    q = scored.agg(F.round(F.percentile("score", F.lit(0.2)), 4).alias("lo"), F.round(F.percentile("score", F.lit(0.9)), 4).alias("hi"))
    return q.select(F.inline(F.array(F.struct(F.lit("all_case_1").alias("clsname"), F.col("lo").alias("threshold")), F.struct(F.lit("all_case_2").alias("clsname"), F.col("hi").alias("threshold")))))


def limits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(scored_tiles(spark, sf_dir))


JUDGED_SQL = SCORED_SQL + """,
limits AS (SELECT round(quantile_cont(score, 0.2), 4) AS lower_, round(quantile_cont(score, 0.9), 4) AS upper_ FROM scored),
judged AS (SELECT *, CASE WHEN score < lower_ THEN 'below' WHEN score > upper_ THEN 'above' ELSE 'Normal' END AS verdict FROM scored, limits)"""


def judged_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(scored_tiles(spark, sf_dir))


@query("WITH " + JUDGED_SQL + """,
base AS (SELECT orchard, count(*) AS total, count_if(verdict = 'Normal') AS n_normal, count_if(verdict = 'below') AS n_below, count_if(verdict = 'above') AS n_above, avg(score) AS mean FROM judged GROUP BY orchard),
t AS (SELECT orchard, avg(score) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY orchard ORDER BY score DESC) AS k FROM judged) WHERE k <= 5 GROUP BY orchard),
b AS (SELECT orchard, avg(score) AS bottom5 FROM (SELECT *, row_number() OVER (PARTITION BY orchard ORDER BY score) AS k FROM judged) WHERE k <= 5 GROUP BY orchard),
r AS (SELECT *, n_below * 100.0 / total AS pct_below, n_above * 100.0 / total AS pct_above, (n_below + n_above) * 100.0 / total AS anomalous_pct FROM base JOIN t USING (orchard) JOIN b USING (orchard)),
p AS (SELECT *, (CASE WHEN bottom5 < 21 THEN 2 ELSE 0 END + CASE WHEN pct_below > 10 THEN 2 ELSE 0 END + CASE WHEN anomalous_pct > 50 THEN 1 ELSE 0 END)::INT AS points_1,
  (CASE WHEN pct_above > 15 THEN 2 ELSE 0 END + CASE WHEN top5 > 75 THEN 2 WHEN top5 > 70 THEN 1 ELSE 0 END + CASE WHEN mean > 50 THEN 1 ELSE 0 END + CASE WHEN anomalous_pct > 50 THEN 1 ELSE 0 END)::INT AS points_2 FROM r)
SELECT orchard, total, n_normal, n_below, n_above, round(mean, 6) AS mean, round(top5, 6) AS top5, round(bottom5, 6) AS bottom5, points_1, points_2,
  CASE WHEN points_1 + points_2 > 1 THEN 'Anomalous' ELSE 'Normal' END AS site_verdict,
  concat_ws(', ', CASE WHEN mean > 45 THEN 'High overall anomaly score' END,
    CASE WHEN points_1 > points_2 + 2 THEN 'High Case 1, low Case 2' WHEN points_2 > points_1 + 2 THEN 'High Case 2, low Case 1' END,
    CASE WHEN top5 - bottom5 > 40 THEN 'Wide range of anomaly scores' END, CASE WHEN top5 > 70 THEN 'High top 5 average' END, CASE WHEN bottom5 < 21 THEN 'Low bottom 5 average' END) AS insights
FROM p""")
def site_verdicts(spark, sf_dir):
    judged = judged_tiles(spark, sf_dir)
    verdicts = E.classify_site(E.class_rollup(judged, "orchard"))
    return rounded(verdicts, "mean", "top5", "bottom5").select("orchard", "total", "n_normal", "n_below", "n_above", "mean", "top5", "bottom5", "points_1", "points_2", "site_verdict", "insights")


@query("WITH " + JUDGED_SQL + """
SELECT orchard, count(*) AS total, count_if(verdict = 'Normal') AS n_normal, count_if(verdict = 'below') AS n_below, count_if(verdict = 'above') AS n_above,
  printf('%.2f%%', count_if(verdict = 'below') * 100.0 / count(*)) AS share_below FROM judged GROUP BY ROLLUP (orchard)""")
def overall_rollup(spark, sf_dir):
    return E.overall_rollup(judged_tiles(spark, sf_dir), "orchard").drop("share_normal", "share_above")


ROC_SQL = SCORES_SQL + """,
counted AS (SELECT clsname, score::DOUBLE AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL),
points AS (SELECT clsname, threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY clsname) AS p, sum(neg) OVER (PARTITION BY clsname) AS n
  FROM counted WINDOW w AS (PARTITION BY clsname ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
roc AS (SELECT *, tp / p AS tpr, fp / n AS fpr FROM (SELECT * FROM points UNION ALL SELECT clsname, 'inf'::DOUBLE, 0, 0, max(p), max(n) FROM points GROUP BY clsname))"""
AUC_SQL = """area AS (SELECT clsname, sum((fpr - pf) * (tpr + pt) / 2) AS auroc FROM (
  SELECT *, lag(fpr) OVER (PARTITION BY clsname ORDER BY threshold DESC) AS pf, lag(tpr) OVER (PARTITION BY clsname ORDER BY threshold DESC) AS pt FROM roc) GROUP BY clsname)"""


@query("WITH " + ROC_SQL + " SELECT clsname, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM roc")
def roc_curve(spark, sf_dir):
    return rounded(E.roc_curve(demo.scores(spark, sf_dir), "clsname"), "tpr", "fpr", places=9).drop("p", "n")


@query("WITH " + ROC_SQL + ", " + AUC_SQL + " SELECT clsname, round(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END, 6) AS auroc FROM area")
def auroc_trapezoid(spark, sf_dir):
    return rounded(E.auroc(demo.scores(spark, sf_dir), "clsname"), "auroc")


@query("WITH " + ROC_SQL + ", " + AUC_SQL + " SELECT clsname, round(auroc, 6) AS auroc FROM area")
def auroc_rank(spark, sf_dir):
    return rounded(E.auroc_by_rank(demo.scores(spark, sf_dir), "clsname"), "auroc")


YOUDEN_SQL = "youden AS (SELECT clsname, threshold FROM (SELECT *, row_number() OVER (PARTITION BY clsname ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) AS k FROM roc) WHERE k = 1)"


@query("WITH " + ROC_SQL + ", " + YOUDEN_SQL + " SELECT * FROM youden")
def youden_threshold(spark, sf_dir):
    return E.youden_threshold(demo.scores(spark, sf_dir), "clsname")


COUNTS_SQL = "counts AS (SELECT clsname, count_if(score >= threshold AND label = 1) AS tp, count_if(score >= threshold AND label = 0) AS fp, count_if(score < threshold AND label = 1) AS fn, count_if(score < threshold AND label = 0) AS tn FROM scores JOIN youden USING (clsname) GROUP BY clsname)"


@query("WITH " + ROC_SQL + ", " + YOUDEN_SQL + ", " + COUNTS_SQL + """ SELECT clsname, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM counts""")
def classification_metrics(spark, sf_dir):
    scores = demo.scores(spark, sf_dir)
    return rounded(E.classification_metrics(scores, E.youden_threshold(scores, "clsname"), "clsname"), "accuracy", "precision", "recall", "f1")


@query("WITH " + ROC_SQL + ", " + YOUDEN_SQL + ", " + COUNTS_SQL + """ SELECT clsname, 0 AS label, 0 AS pred, tn AS n FROM counts UNION ALL SELECT clsname, 0, 1, fp FROM counts
  UNION ALL SELECT clsname, 1, 0, fn FROM counts UNION ALL SELECT clsname, 1, 1, tp FROM counts""")
def confusion_matrix(spark, sf_dir):
    scores = demo.scores(spark, sf_dir)
    return E.confusion_matrix(scores, E.youden_threshold(scores, "clsname"), "clsname")


ORIENTED_SQL = SCORES_SQL.replace("scores AS", "given AS") + """,
sides AS (SELECT clsname, coalesce(avg(CASE WHEN label = 1 THEN score END) < avg(CASE WHEN label = 0 THEN score END), false) AS inverted, max(score) AS max_score FROM given GROUP BY clsname),
scores AS (SELECT clsname, tile_id, label, CASE WHEN inverted THEN round(max_score - score, 6) ELSE score END AS score, inverted, max_score FROM given JOIN sides USING (clsname))"""


@query("WITH " + ORIENTED_SQL + " SELECT clsname, tile_id, label, round(score, 6) AS score, inverted FROM scores")
def orient_scores(spark, sf_dir):
    return rounded(E.orient_scores(demo.scores(spark, sf_dir), "clsname"), "score").select("clsname", "tile_id", "label", "score", "inverted")


_ORIENTED_ROC = ORIENTED_SQL + ROC_SQL[len(SCORES_SQL) :]


@query("WITH " + _ORIENTED_ROC + ", " + AUC_SQL + ", " + YOUDEN_SQL + ", " + COUNTS_SQL + """
SELECT clsname, round(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END, 6) AS auroc, round(threshold, 6) AS threshold, inverted, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy
FROM area JOIN youden USING (clsname) JOIN sides USING (clsname) JOIN counts USING (clsname)""")
def evaluate_classes(spark, sf_dir):
    metrics = E.evaluate(demo.scores(spark, sf_dir), "clsname")
    return rounded(metrics, "auroc", "threshold", "accuracy").select("clsname", "auroc", "threshold", "inverted", "accuracy")


@query("WITH " + _ORIENTED_ROC + ", " + YOUDEN_SQL + """, raw AS (SELECT clsname, CASE WHEN inverted THEN max_score - threshold ELSE threshold END AS t FROM youden JOIN sides USING (clsname)),
two AS (SELECT max(CASE WHEN k = 1 THEN t END) AS lo, max(CASE WHEN k = 2 THEN t END) AS hi FROM (SELECT t, row_number() OVER (ORDER BY clsname) AS k FROM raw))
SELECT clsname, tile_id, CASE WHEN score < lo THEN 'below' WHEN score > hi THEN 'above' ELSE 'Normal' END AS verdict FROM given, two""")
def raw_thresholds(spark, sf_dir):
    """Scores as they were given, judged by thresholds turned back into them."""
    given = demo.scores(spark, sf_dir)
    thresholds = written(E.thresholds_table(rounded(E.orient_scores(given, "clsname"), "score"), "clsname"), "thresholds")
    lower, upper = (r[0] for r in thresholds.select("clsname").orderBy("clsname").limit(2).collect())
    return E.apply_thresholds(given, thresholds, lower, upper, space="raw").select("clsname", "tile_id", "verdict")


@query("WITH " + ROC_SQL + ", " + AUC_SQL + " SELECT 'mean_value_auc' AS name, round(avg(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END), 6) AS \"value\" FROM area")
def macro_mean(spark, sf_dir):
    return rounded(E.macro_mean(E.auroc(demo.scores(spark, sf_dir), "clsname").withColumn("metric", F.lit("value"))), "value")


@query("WITH " + ROC_SQL + ", " + AUC_SQL + """, folded AS (SELECT clsname, round(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END, 6) AS "value" FROM area)
SELECT clsname, "value", 0 AS place FROM folded UNION ALL SELECT 'mean', round(avg("value"), 5), 1 FROM folded""")
def metric_report(spark, sf_dir):
    metrics = rounded(E.auroc(demo.scores(spark, sf_dir), "clsname"), "auroc").withColumn("metric", F.lit("value"))
    return E.metric_report(metrics, ["value"]).withColumn("value", F.when(F.col("place") == 1, F.round("value", 5)).otherwise(F.col("value")))


@query("WITH " + SCORES_SQL + """, limits AS (SELECT clsname, label, min(score) AS lo, max(score) AS hi FROM scores GROUP BY ALL)
SELECT clsname, label, least(coalesce(floor((score - lo) / nullif(hi - lo, 0) * 50), 0), 49)::INT AS bin, count(*) AS n FROM scores JOIN limits USING (clsname, label) GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    return E.score_histogram(demo.scores(spark, sf_dir), 50, "clsname")


@query("WITH " + SCORES_SQL + """, g AS (SELECT 'all' AS "group", score FROM scores UNION ALL SELECT CASE label WHEN 1 THEN 'defective' ELSE 'good' END, score FROM scores)
SELECT "group", round(avg(score), 5) AS mean, round(median(score), 5) AS median, round(stddev_pop(score), 5) AS std, min(score) AS min, max(score) AS max FROM g GROUP BY ALL""")
def score_summary(spark, sf_dir):
    return rounded(E.score_summary(demo.scores(spark, sf_dir)), "mean", "median", "std", places=5)


@query("WITH " + SCORES_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY clsname ORDER BY score DESC) AS k FROM scores) SELECT clsname, round(avg(score), 5) AS top5 FROM k WHERE k <= 5 GROUP BY clsname")
def top_k_mean(spark, sf_dir):
    return rounded(E.k_mean(demo.scores(spark, sf_dir), 5, "clsname", True, "top5"), "top5", places=5)


@query("WITH " + SCORES_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY clsname ORDER BY score) AS k FROM scores) SELECT clsname, round(avg(score), 5) AS bottom5 FROM k WHERE k <= 5 GROUP BY clsname")
def bottom_k_mean(spark, sf_dir):
    return rounded(E.k_mean(demo.scores(spark, sf_dir), 5, "clsname", False, "bottom5"), "bottom5", places=5)


@query("WITH " + SCORES_SQL + " SELECT clsname, tile_id, CASE WHEN score < 20 THEN 'below' WHEN score > 80 THEN 'above' ELSE 'Normal' END AS verdict FROM scores")
def classify_score(spark, sf_dir):
    return demo.scores(spark, sf_dir).select("clsname", "tile_id", C.verdict(F.col("score"), F.lit(20.0), F.lit(80.0)).alias("verdict"))


@query("WITH " + MASK_SQL + ", " + ROC_SQL.replace(SCORES_SQL, "scores AS (SELECT raster_id AS clsname, 0 AS tile_id, v AS label, (y * 7 + x * 3) % 50 AS score FROM mask)") + ", " + AUC_SQL + " SELECT clsname AS raster_id, round(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END, 6) AS auroc FROM area")
def pixel_auroc(spark, sf_dir):
    cells = demo.mask(spark, sf_dir).select("raster_id", F.col("v").alias("mask"), ((F.col("y") * 7 + F.col("x") * 3) % 50).alias("pred"))
    return rounded(E.pixel_auroc(cells, "raster_id"), "auroc")


# Tiles.
@query("WITH " + TILES_SQL + " SELECT tile_id, y::INT AS y, x::INT AS x, round(v, 6) AS v FROM cells")
def tiles_to_cells(spark, sf_dir):
    return rounded(T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id"), "v").drop("b")


@query("WITH " + TILES_SQL + " SELECT tile_id, 8 AS height, 8 AS width, round(list_sum(list_transform(range(1, 65), lambda i: i * embedding[i]::DOUBLE)), 4) AS digest FROM tiles")
def cells_to_tiles(spark, sf_dir):
    cells = T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id")
    digest = F.aggregate(F.transform("data", lambda v, i: (i + 1) * v), F.lit(0.0), lambda s, v: s + v)
    return T.cells_to_tiles(cells, "tile_id").select("tile_id", "height", "width", F.round(digest, 4).alias("digest"))


@query("WITH " + TILES_SQL + " SELECT tile_id, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99 FROM cells GROUP BY tile_id")
def tile_percentiles(spark, sf_dir):
    return rounded(T.tile_percentiles(T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id"), "tile_id"), "p1", "p99").drop("b")


RANGE_SQL = ", ranges AS (SELECT orchard, min(p1) AS lo, max(p99) AS hi FROM (SELECT orchard, tile_id, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM cells GROUP BY ALL) GROUP BY orchard)"


@query("WITH " + TILES_SQL + RANGE_SQL + " SELECT orchard, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ranges")
def site_range(spark, sf_dir):
    cells = T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id", "orchard")
    return rounded(T.site_range(T.tile_percentiles(cells, "orchard", "tile_id")), "lo", "hi").drop("b")


@query("WITH " + TILES_SQL + " SELECT orchard, count(*) AS n, true AS low_holds, true AS high_holds FROM cells GROUP BY orchard")
def sketched_range(spark, sf_dir):
    """Ranks of what the merged sketches of two halves of the tiles give are within the error, with a value of slack."""
    cells = T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id", "orchard")
    halves = [T.site_sketches(cells.where(F.col("tile_id") % 2 == k)) for k in (0, 1)]
    found = T.sketched_range(T.merged_sketches(halves[0].unionByName(halves[1])))
    met = cells.join(found, ["orchard", "b"]).groupBy("orchard").agg(F.count("*").alias("n"), *[F.count_if(F.col("v") < F.col(c)).alias(f"{c}_below") for c in ("lo", "hi")], *[F.count_if(F.col("v") <= F.col(c)).alias(f"{c}_upto") for c in ("lo", "hi")])
    slack = T.RANK_ERROR * F.col("n") + 1
    holds = lambda c, rank: (F.col(f"{c}_below") <= rank * F.col("n") + slack) & (F.col(f"{c}_upto") >= rank * F.col("n") - slack)
    return met.select("orchard", "n", holds("lo", 0.01).alias("low_holds"), holds("hi", 0.99).alias("high_holds"))


@query("WITH " + TILES_SQL + RANGE_SQL + " SELECT tile_id, round(avg(least(1, greatest(0, (v - lo) / nullif(hi - lo, 0)))), 5) AS mean, round(max(least(1, greatest(0, (v - lo) / nullif(hi - lo, 0)))), 5) AS top FROM cells JOIN ranges USING (orchard) GROUP BY tile_id")
def minmax_scale(spark, sf_dir):
    cells = T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id", "orchard")
    scaled = cells.join(T.site_range(T.tile_percentiles(cells, "orchard", "tile_id")), ["orchard", "b"]).withColumn("v", C.minmax(F.col("v"), F.col("lo"), F.col("hi")))
    return rounded(scaled.groupBy("tile_id").agg(F.avg("v").alias("mean"), F.max("v").alias("top")), "mean", "top", places=5)


@query("WITH " + TILES_SQL + " SELECT orchard, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cells WHERE case_ = 'normal' GROUP BY orchard")
def channel_stats(spark, sf_dir):
    normal = demo.tiles(spark, sf_dir).where("case = 'normal'")
    return rounded(T.channel_stats(T.tiles_to_cells(normal, "tile_id", "orchard")), "mean", "std").drop("b")


@query("WITH " + TILES_SQL + " SELECT tile_id, 'mean' AS metric, round(avg(v), 6) AS score FROM cells GROUP BY tile_id UNION ALL SELECT tile_id, 'std', round(stddev_pop(v), 6) FROM cells GROUP BY tile_id")
def map_scores(spark, sf_dir):
    return rounded(T.map_scores(T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id"), "tile_id"), "score")


@query("WITH " + TILES_SQL + """, p AS (SELECT a.tile_id, a.y, a.x, avg(b.v) AS m, count(*) AS n FROM cells a JOIN cells b ON a.tile_id = b.tile_id AND b.y BETWEEN a.y - 2 AND a.y + 1 AND b.x BETWEEN a.x - 2 AND a.x + 1 GROUP BY ALL)
SELECT tile_id, round(max(m), 6) AS score FROM p WHERE n = 16 GROUP BY tile_id""")
def pooled_max(spark, sf_dir):
    return rounded(T.pooled_max(T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id"), 4, "tile_id"), "score")


@query("WITH " + TILES_SQL + " SELECT tile_id, 'max' AS metric, round(max(v), 6) AS score FROM cells GROUP BY tile_id UNION ALL SELECT tile_id, 'mean', round(avg(v), 6) FROM cells GROUP BY tile_id UNION ALL SELECT tile_id, 'std', round(stddev_pop(v), 6) FROM cells GROUP BY tile_id")
def encoders(spark, sf_dir):
    return rounded(E.encode(demo.tiles(spark, sf_dir).select("tile_id", F.col("data").alias("map")), ["mean", "std", "max"], "tile_id"), "score")


SPLIT_SQL = TILES_SQL + """,
moves AS (SELECT orchard, least(coalesce(largest, 0), normals // 4) AS move FROM (SELECT orchard, count_if(case_ = 'normal') AS normals FROM tiles GROUP BY orchard)
  LEFT JOIN (SELECT orchard, max(n) AS largest FROM (SELECT orchard, case_, count(*) AS n FROM tiles WHERE case_ <> 'normal' GROUP BY ALL) GROUP BY orchard) USING (orchard)),
split AS (SELECT tile_id, orchard, case_, CASE WHEN case_ <> 'normal' OR k <= move THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY orchard, case_ ORDER BY md5(tile_id || '|seed'), tile_id) AS k FROM tiles) JOIN moves USING (orchard))"""


@query("WITH " + SPLIT_SQL + " SELECT orchard, move FROM moves")
def move_counts(spark, sf_dir):
    return D.move_counts(demo.tiles(spark, sf_dir))


@query("WITH " + SPLIT_SQL + ' SELECT tile_id, orchard, case_ AS "case", split FROM split')
def train_test_split(spark, sf_dir):
    return D.train_test_split(demo.tiles(spark, sf_dir), "tile_id", SEED).select("tile_id", "orchard", "case", "split")


@query("WITH " + TILES_SQL + ' SELECT tile_id, orchard, case_ AS "case" FROM (SELECT *, row_number() OVER (PARTITION BY orchard, case_ ORDER BY md5(tile_id || \'|seed\'), tile_id) AS k FROM tiles) WHERE k <= 3')
def sample_k(spark, sf_dir):
    return D.sample_k(demo.tiles(spark, sf_dir), ["orchard", "case"], "tile_id", 3, SEED).select("tile_id", "orchard", "case")


TEST_SQL = SPLIT_SQL + """,
cases AS (SELECT * FROM split WHERE split = 'test' AND case_ <> 'normal' AND orchard IN (SELECT orchard FROM split WHERE split = 'test' AND case_ = 'normal')),
sizes AS (SELECT orchard, case_ AS kind, count(*) AS size FROM cases GROUP BY ALL),
normals AS (SELECT s.tile_id, s.orchard, kind, size FROM split s JOIN sizes USING (orchard) WHERE split = 'test' AND case_ = 'normal'),
meta AS (
  SELECT tile_id, orchard, 'all_' || case_ AS clsname, 1 AS label FROM cases UNION ALL SELECT tile_id, orchard, orchard || '_' || case_, 1 FROM cases
  UNION ALL SELECT tile_id, orchard, 'all_' || kind, 0 FROM (SELECT *, row_number() OVER (PARTITION BY orchard, kind ORDER BY md5(tile_id || '|seed|all|' || kind), tile_id) AS k FROM normals) WHERE k <= size
  UNION ALL SELECT tile_id, orchard, orchard || '_' || kind, 0 FROM (SELECT *, row_number() OVER (PARTITION BY orchard, kind ORDER BY md5(tile_id || '|seed|site|' || kind), tile_id) AS k FROM normals) WHERE k <= size)"""


def _test_metadata(spark, sf_dir):
    split = D.train_test_split(demo.tiles(spark, sf_dir), "tile_id", SEED).select("tile_id", "orchard", "case", "split")
    return D.build_test_metadata(split, "tile_id", SEED)


@query("WITH " + TEST_SQL + " SELECT tile_id, orchard, clsname, label FROM meta")
def build_test_metadata(spark, sf_dir):
    return _test_metadata(spark, sf_dir).select("tile_id", "orchard", "clsname", "label")


@query("WITH " + TEST_SQL + " SELECT clsname, count_if(label = 0) AS normal, count_if(label = 1) AS defective FROM meta GROUP BY clsname")
def case_statistics(spark, sf_dir):
    return D.case_statistics(_test_metadata(spark, sf_dir))


@query("WITH " + SPLIT_SQL + ", s AS (SELECT orchard, avg(v) AS m FROM cells GROUP BY orchard) SELECT tile_id, orchard, orchard AS clsname, 0 AS label, 'good' AS label_name, round(m, 6) AS site_mean FROM split JOIN s USING (orchard) WHERE split = 'train' AND case_ = 'normal'")
def build_train_metadata(spark, sf_dir):
    tiles = demo.tiles(spark, sf_dir)
    split = D.train_test_split(tiles, "tile_id", SEED).select("tile_id", "orchard", "case", "split")
    rows = D.attach_stats(D.build_train_metadata(split), T.channel_stats(T.tiles_to_cells(tiles, "orchard")))
    return rows.select("tile_id", "orchard", "clsname", "label", "label_name", F.round(F.element_at("mean", 1), 6).alias("site_mean"))


@query("WITH " + TILES_SQL + " SELECT tile_id, CASE WHEN (tile_id % 10) IN (1, 3) THEN 0 ELSE 1 END AS label FROM tiles")
def one_class_relabel(spark, sf_dir):
    return demo.tiles(spark, sf_dir).select("tile_id", C.one_class_label(F.col("tile_id") % 10, [1, 3]).alias("label"))


@query("WITH " + TILES_SQL + " SELECT tile_id, round(sum(v * (y * 8 + (7 - x))), 4) AS h, round(sum(v * ((7 - y) * 8 + x)), 4) AS v, round(sum(v * ((7 - x) * 8 + y)), 4) AS r90, round(sum(v * ((7 - y) * 8 + (7 - x))), 4) AS r180, round(sum(v * (x * 8 + (7 - y))), 4) AS r270 FROM cells GROUP BY tile_id")
def flips_and_turns(spark, sf_dir):
    digest = lambda turn: F.round(F.aggregate(F.transform(C.turned(F.col("data"), 8, 8, 1, turn), lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v), 4)
    return demo.tiles(spark, sf_dir).select("tile_id", digest("h").alias("h"), digest("v").alias("v"), digest("90").alias("r90"), digest("180").alias("r180"), digest("270").alias("r270"))


_DRAWN_SQL = TILES_SQL + """, drawn AS (SELECT tile_id, substr(md5(tile_id || '|seed|h'), 1, 1) < '8' AS h, substr(md5(tile_id || '|seed|v'), 1, 1) < '8' AS v_, ('0x' || substr(md5(tile_id || '|seed|t'), 1, 1))::INT % 4 AS turn FROM tiles),
flipped AS (SELECT tile_id, turn, v, CASE WHEN v_ THEN 7 - y ELSE y END AS y, CASE WHEN h THEN 7 - x ELSE x END AS x FROM cells JOIN drawn USING (tile_id)),
moved AS (SELECT tile_id, turn, v, CASE turn WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS y, CASE turn WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS x FROM flipped)"""


@query("WITH " + _DRAWN_SQL + " SELECT tile_id, turn, round(sum(v * (y * 8 + x)), 4) AS digest, sum(CASE WHEN v > 0 THEN y * 8 + x ELSE 0 END)::BIGINT AS mask_digest FROM moved GROUP BY ALL")
def drawn_turns(spark, sf_dir):
    """A tile and its mask take the same flips and turn."""
    mask = F.transform("data", lambda v: F.when(v > 0, 1).otherwise(0).cast("long"))
    drawn = demo.tiles(spark, sf_dir).withColumn("mask", mask).withColumn("draw", C.drawn_turns(F.col("tile_id"), SEED))
    both = [C.turned_as_drawn(F.col(c), 8, 1, F.col("draw")) for c in ("data", "mask")]
    digest = lambda a, zero: F.aggregate(F.transform(a, lambda v, i: v * i), zero, lambda s, v: s + v)
    return drawn.select("tile_id", F.col("draw.turn").alias("turn"), F.round(digest(both[0], F.lit(0.0)), 4).alias("digest"), digest(both[1], F.lit(0).cast("long")).alias("mask_digest"))


@query("WITH " + TILES_SQL + " SELECT tile_id, tile_id % 11 % 10 AS cls, CASE WHEN tile_id % 11 % 10 IN (1, 3) THEN 0 ELSE 1 END AS label, 'test' AS side FROM tiles UNION ALL SELECT tile_id, tile_id % 11 % 10, 0, 'train' FROM tiles WHERE tile_id % 11 % 10 IN (1, 3)")
def one_class_rows(spark, sf_dir):
    rows = demo.tiles(spark, sf_dir).select("tile_id", (F.col("tile_id") % 11).alias("cls"))
    sides = [D.one_class_rows(rows, "cls", [1, 3], side).withColumn("side", F.lit(side)) for side in ("test", "train")]
    return sides[0].unionByName(sides[1]).select("tile_id", "cls", "label", "side")


@query("WITH " + TILES_SQL + ", several AS (SELECT * FROM tiles WHERE NOT (orchard = 'site_2' AND case_ = 'case_3')) SELECT tile_id, orchard FROM several WHERE orchard IN (SELECT orchard FROM several GROUP BY orchard HAVING count(DISTINCT case_) = 4)")
def complete_sites(spark, sf_dir):
    tiles = demo.tiles(spark, sf_dir).where(~((F.col("orchard") == "site_2") & (F.col("case") == "case_3")))
    return D.complete_sites(tiles).select("tile_id", "orchard")


@query("WITH " + TILES_SQL + " SELECT tile_id, round(sum((v - 0.5) / 0.25), 4) AS normalized, round(sum((v * 0.25 + 0.5) * 255), 3) AS denormalized FROM cells GROUP BY tile_id")
def normalize_bands(spark, sf_dir):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n, d = (f(F.col("data"), [0.5], [0.25], F.col("channels")) for f in (C.normalize_bands, C.denormalize_bands))
    return demo.tiles(spark, sf_dir).select("tile_id", F.round(total(n), 4).alias("normalized"), F.round(total(d), 3).alias("denormalized"))


@query("WITH " + TILES_SQL + ", s AS (SELECT tile_id, min(v) AS lo, max(v) AS hi FROM cells GROUP BY tile_id) SELECT tile_id, round(sum((v - lo) / nullif(hi - lo, 0)), 4) AS total FROM cells JOIN s USING (tile_id) GROUP BY tile_id")
def normalize_self(spark, sf_dir):
    return rounded(W.normalize_self(T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id"), ["tile_id"]).groupBy("tile_id").agg(F.sum("v").alias("total")), "total", places=4)


@query("WITH " + TILES_SQL + ", s AS (SELECT min(v) AS lo FROM cells) SELECT tile_id, round(sum((least(1, greatest(lo, v)) - lo) / nullif(1 - lo, 0)), 4) AS total FROM cells, s GROUP BY tile_id")
def normalize_global(spark, sf_dir):
    return rounded(W.normalize_global(T.tiles_to_cells(demo.tiles(spark, sf_dir), "tile_id"), None, 1.0).groupBy("tile_id").agg(F.sum("v").alias("total")), "total", places=4)


@query("WITH " + TILES_SQL + ", s AS (SELECT orchard, y, x, avg(v) AS m FROM cells GROUP BY ALL) SELECT tile_id, round(sqrt(sum((v - m) ** 2)), 5) AS distance, round(avg((v - m) ** 2), 5) AS mse FROM cells JOIN s USING (orchard, y, x) GROUP BY tile_id")
def feature_error(spark, sf_dir):
    tiles = demo.tiles(spark, sf_dir)
    mean = T.tiles_to_cells(tiles, "orchard").groupBy("orchard", "y", "x", "b").agg(F.avg("v").alias("v"))
    rec = T.cells_to_tiles(mean, "orchard").select("orchard", F.col("data").alias("rec"))
    both = tiles.join(rec, "orchard")
    return both.select("tile_id", F.round(C.anomaly_distance(F.col("data"), F.col("rec")), 5).alias("distance"), F.round(C.mean_square(F.col("data"), F.col("rec")), 5).alias("mse"))


# Rasters and masks.
@query("WITH " + RASTER_SQL + " SELECT raster_id, y, x, v FROM raster WHERE 1000.0 + x * 2.0 BETWEEN 1010 AND 1060 AND 500.0 - y * 2.0 BETWEEN 420 AND 480")
def clip_bounds(spark, sf_dir):
    cells = demo.raster(spark, sf_dir)
    at = cells.select("raster_id").distinct().select("raster_id", F.lit(2.0).alias("px"), F.lit(-2.0).alias("py"), F.lit(1000.0).alias("left"), F.lit(500.0).alias("top"))
    return T.clip_bounds(cells, at, 1010, 420, 1060, 480)


LAYERS_SQL = MASK_SQL + """, layers AS (SELECT m.raster_id, m.y, m.x, CASE WHEN m.v = 0 THEN -999 WHEN r.v % 4 = 3 THEN 3 ELSE 1 + (r.v::INT % 2) END AS mask, CASE WHEN r.v > 2000 THEN -32767.0 ELSE 0.0 END AS ref, r.v FROM mask m JOIN raster r USING (raster_id, y, x)),
placed AS (SELECT raster_id, i.i::INT AS i, j.i::INT AS j, y, x, mask, ref, v FROM layers, range(10) i(i), range(10) j(i) WHERE y BETWEEN i.i * 6 AND i.i * 6 + 7 AND x BETWEEN j.i * 6 AND j.i * 6 + 7)"""


def _layers(spark, sf_dir):
    cells, on = demo.raster(spark, sf_dir), demo.mask(spark, sf_dir)
    kind = F.when(on["v"] == 0, -999).when(cells["v"] % 4 == 3, 3).otherwise(1 + cells["v"].cast("int") % 2)
    mask = cells.join(on, ["raster_id", "y", "x"]).select("raster_id", "y", "x", kind.alias("mask"))
    ref = cells.select("raster_id", "y", "x", F.when(F.col("v") > 2000, -32767.0).otherwise(0.0).alias("ref"))
    return T.assign_tiles(T.colocate(cells, mask, ref), 64, 64, 8, 2)


@query("WITH " + LAYERS_SQL + " SELECT raster_id, i, j, count(*) AS n, sum(v) AS v FROM placed GROUP BY ALL")
def assign_tiles(spark, sf_dir):
    return _layers(spark, sf_dir).groupBy("raster_id", "i", "j").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("WITH " + LAYERS_SQL + " SELECT raster_id, i, j FROM placed GROUP BY ALL HAVING NOT bool_or(mask = 0 OR ref = -32767)")
def valid_tiles(spark, sf_dir):
    return T.valid_tiles(_layers(spark, sf_dir), "raster_id", "i", "j")


@query("WITH " + LAYERS_SQL + """, n AS (SELECT raster_id, i, j, count_if(mask = 1) AS n1, count_if(mask = 2) AS n2, count_if(mask = 3) AS n3 FROM placed GROUP BY ALL)
SELECT * FROM (SELECT raster_id, i, j, CASE WHEN n1 >= 16 THEN 'case_1' WHEN n2 >= 16 THEN 'case_2' WHEN n3 >= 16 THEN 'case_3' WHEN n1 + n2 = 0 THEN 'normal' END AS "case" FROM n) WHERE "case" IS NOT NULL""")
def classify_tiles(spark, sf_dir):
    return T.classify_tiles(_layers(spark, sf_dir), 0.25, 64, "raster_id", "i", "j").drop("n1", "n2", "n3")


BOX_SQL = "SELECT a.raster_id, a.y, a.x, {f}(b.v) AS v FROM {t} a JOIN {t} b ON a.raster_id = b.raster_id AND b.y BETWEEN a.y - {lo} AND a.y + {hi} AND b.x BETWEEN a.x - {lo} AND a.x + {hi} GROUP BY ALL"


@query("WITH " + RASTER_SQL + " " + BOX_SQL.format(f="max", t="raster", lo=2, hi=2))
def dilate_box(spark, sf_dir):
    return W.dilate(demo.raster(spark, sf_dir), 5, RASTER)


@query("WITH " + RASTER_SQL + " " + BOX_SQL.format(f="min", t="raster", lo=2, hi=1))
def erode_box(spark, sf_dir):
    return W.erode(demo.raster(spark, sf_dir), 4, RASTER)


@query("WITH " + MASK_SQL + ", d AS (" + BOX_SQL.format(f="max", t="mask", lo=1, hi=1) + ") " + BOX_SQL.format(f="min", t="d", lo=1, hi=1))
def close_box(spark, sf_dir):
    return W.close(demo.mask(spark, sf_dir), 3, RASTER)


@query("WITH " + MASK_SQL + ", d AS (" + BOX_SQL.format(f="min", t="mask", lo=1, hi=1) + ") " + BOX_SQL.format(f="max", t="d", lo=1, hi=1))
def open_box(spark, sf_dir):
    return W.open_(demo.mask(spark, sf_dir), 3, RASTER)


@query("WITH " + RASTER_SQL + ", p AS (SELECT a.raster_id, a.y, a.x, avg(b.v) AS v, count(*) AS n FROM raster a JOIN raster b ON a.raster_id = b.raster_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL) SELECT raster_id, y, x, round(v, 5) AS pooled FROM p WHERE n = 9")
def box_mean(spark, sf_dir):
    return rounded(W.box_mean(demo.raster(spark, sf_dir), 3, 3, RASTER), "pooled", places=5)


_L1 = "SELECT a.raster_id, a.y, a.x, max(b.v) AS v FROM mask a JOIN mask b ON a.raster_id = b.raster_id AND abs(a.y - b.y) + abs(a.x - b.x) <= {r} GROUP BY ALL"


@query("WITH " + MASK_SQL.replace("v > m", "v > 3 * m") + " " + _L1.format(r=4))
def l1_dilate(spark, sf_dir):
    return W.l1_dilate(demo.mask(spark, sf_dir, times=3), 4, RASTER)


@query("WITH " + MASK_SQL + " " + _L1.format(r=1))
def neighbour_join(spark, sf_dir):
    return G.neighbour_join(demo.mask(spark, sf_dir), [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])


@query("WITH " + MASK_SQL + " " + _L1.format(r=1))
def ellipse_dilate(spark, sf_dir):
    return W.ellipse_dilate(demo.mask(spark, sf_dir), 3, RASTER)


@query("WITH " + RASTER_SQL + " SELECT t.raster_id, a.i::INT AS y, b.i::INT AS x, t.v FROM raster t, range(100) a(i), range(80) b(i) WHERE t.y = a.i * 64 // 100 AND t.x = b.i * 64 // 80")
def resample_nearest(spark, sf_dir):
    return G.resample_nearest(demo.raster(spark, sf_dir), 100, 80)


@query("WITH " + RASTER_SQL + """, t AS (SELECT a.i::INT AS ty, b.i::INT AS tx, least(greatest((a.i + 0.5) * 64 / 40 - 0.5, 0), 63) AS sy, least(greatest((b.i + 0.5) * 64 / 100 - 0.5, 0), 63) AS sx FROM range(40) a(i), range(100) b(i)),
c AS (SELECT ty, tx, least(floor(sy)::INT + dy.i, 63) AS y, least(floor(sx)::INT + dx.i, 63) AS x, (CASE dy.i WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE dx.i WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM t, range(2) dy(i), range(2) dx(i))
SELECT raster_id, ty AS y, tx AS x, round(sum(v * w), 5) AS v FROM c JOIN raster USING (y, x) GROUP BY ALL""")
def resample_bilinear(spark, sf_dir):
    return rounded(G.resample_bilinear(demo.raster(spark, sf_dir), 40, 100), "v", places=5)


@query("WITH " + RASTER_SQL + """, part AS (SELECT a.i AS at, t.i AS "to", least(20 * a.i + 20, 64 * t.i + 64) - greatest(20 * a.i, 64 * t.i) AS part FROM range(64) a(i), range(20) t(i) WHERE 20 * a.i < 64 * t.i + 64 AND 64 * t.i < 20 * a.i + 20)
SELECT raster_id, p."to"::INT AS y, q."to"::INT AS x, round(sum(v * p.part * q.part) / 4096, 5) AS v FROM raster JOIN part p ON p.at = y JOIN part q ON q.at = x GROUP BY ALL""")
def regrid(spark, sf_dir):
    return rounded(G.regrid(demo.raster(spark, sf_dir), 20, 30), "v", places=5)


def _stripes(spark, sf_dir):
    return demo.raster(spark, sf_dir).select("raster_id", "y", "x", F.when(F.col("y") % 3 == 0, 1).otherwise(0).alias("v"))


@query("WITH " + MASK_SQL + " SELECT raster_id, y, x, greatest(v, CASE WHEN y % 3 = 0 THEN 1 ELSE 0 END) AS v FROM mask")
def mask_union(spark, sf_dir):
    return G.mask_union([demo.mask(spark, sf_dir), _stripes(spark, sf_dir)])


@query("WITH " + MASK_SQL + " SELECT raster_id, y, x, v FROM mask WHERE v = 1 AND y % 3 = 0")
def mask_intersect(spark, sf_dir):
    return G.mask_intersect(demo.mask(spark, sf_dir), _stripes(spark, sf_dir))


@query("WITH " + MASK_SQL + " SELECT raster_id, y, x, CASE WHEN v = 1 THEN 0 ELSE -999 END AS v FROM mask")
def encode_mask(spark, sf_dir):
    return G.mask_complement(demo.mask(spark, sf_dir)).withColumn("v", C.encode_mask(F.col("v") == 1))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem),
m AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM c),
h AS (SELECT *, CASE WHEN v = lo THEN 0.0 WHEN v = r THEN 60 * (g - b) / (v - lo) WHEN v = g THEN 120 + 60 * (b - r) / (v - lo) ELSE 240 + 60 * (r - g) / (v - lo) END AS t FROM m),
k AS (SELECT *, round(CASE WHEN t < 0 THEN t + 360 ELSE t END / 2)::INT AS q FROM h)
SELECT l_orderkey, l_linenumber, CASE WHEN q >= 180 THEN q - 180 ELSE q END AS h, coalesce(round(255 * (v - lo) / nullif(v, 0)), 0)::INT AS s, v::INT AS v FROM k""")
def hsv(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", C.hsv(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("WITH " + MASK_SQL + " SELECT raster_id, round(avg(v), 6) AS covered, avg(v) > 0.3 AS accepted FROM mask GROUP BY raster_id")
def accept_raster(spark, sf_dir):
    return rounded(M.accept_raster(demo.mask(spark, sf_dir), 0.3), "covered")


# Runs.
@query("WITH " + RUNS_SQL + " SELECT model, epoch, (auroc_1 + auroc_2) / 2 AS average FROM runs")
def run_average(spark, sf_dir):
    return R.run_average(demo.runs(spark, sf_dir)).select("model", "epoch", "average")


@query("WITH " + RUNS_SQL + " SELECT model, epoch, auroc_1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY auroc_1 DESC, epoch) AS k FROM runs) WHERE k = 1")
def best_epoch(spark, sf_dir):
    return R.best_epoch(demo.runs(spark, sf_dir), "auroc_1", "model")


@query("WITH " + RUNS_SQL + ", l AS (SELECT model, min(auroc_1) AS lo, max(auroc_1) AS hi FROM runs GROUP BY model) SELECT model, round(greatest(0, lo - 0.05 * (hi - lo)), 9) AS auroc_1_min, round(least(1, hi + 0.05 * (hi - lo)), 9) AS auroc_1_max FROM l")
def run_limits(spark, sf_dir):
    return rounded(R.run_limits(demo.runs(spark, sf_dir), ["auroc_1"], "model"), "auroc_1_min", "auroc_1_max", places=9)


@query("WITH " + RUNS_SQL + " SELECT model, epoch, round(avg(auroc_1) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS average FROM runs")
def moving_average(spark, sf_dir):
    return rounded(W.moving_average(demo.runs(spark, sf_dir), 5, ["model"], "epoch", "auroc_1"), "average", places=8).select("model", "epoch", "average")


@query("WITH " + RUNS_SQL + " SELECT model, epoch, round(sum(auroc_1 * n) OVER w / sum(n) OVER w, 8) AS average FROM runs WINDOW w AS (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_weighted_mean(spark, sf_dir):
    return rounded(W.running_weighted_mean(demo.runs(spark, sf_dir), ["model"], "epoch", "auroc_1", "n"), "average", places=8).select("model", "epoch", "average")


@query("WITH " + RUNS_SQL + ", b AS (SELECT *, greatest(0.0, coalesce(max(auroc_1) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS best FROM runs) SELECT model, epoch, best, auroc_1 >= best AS is_best FROM b")
def running_best(spark, sf_dir):
    return W.running_best(demo.runs(spark, sf_dir), ["model"], "epoch", "auroc_1").select("model", "epoch", "best", "is_best")


@query("WITH " + RUNS_SQL + " SELECT model, round(sum(auroc_1 * n) / sum(n), 9) AS mean FROM runs GROUP BY model")
def weighted_mean(spark, sf_dir):
    return rounded(R.weighted_mean(demo.runs(spark, sf_dir), "auroc_1", "n", "model"), "mean", places=9)


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id, regexp_replace('/data/' || event_type || '.tif', '[/\\\\.]', '_', 'g') AS unique_id FROM events")
def names(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.col("event_type"), F.lit(".tif"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.run_id(F.col("ts")).alias("run_id"), C.unique_id(path).alias("unique_id"))


# Scalars, layers and sets.
@query("""SELECT l_orderkey, l_linenumber, (100.0)::DOUBLE + l_linenumber * (0.5)::DOUBLE AS wx, (200.0)::DOUBLE - l_linenumber * (0.25)::DOUBLE AS wy, floor((l_quantity - (3.0)::DOUBLE) / (0.5)::DOUBLE)::BIGINT AS px, floor((l_quantity - (9.0)::DOUBLE) / (-0.25)::DOUBLE)::BIGINT AS py,
  trunc(trunc(l_extendedprice / abs((-1e-6)::DOUBLE * l_linenumber)) * (1e-6)::DOUBLE)::INT AS patch, trunc((0.37)::DOUBLE * l_partkey)::INT AS w, trunc((0.37)::DOUBLE * l_suppkey)::INT AS h, (0.5)::DOUBLE * l_tax + (0.5)::DOUBLE * l_discount AS blended FROM lineitem""")
def pixel_geometry(spark, sf_dir):
    n, q, lit = F.col("l_linenumber"), F.col("l_quantity"), F.lit
    wx, wy = C.pixel_to_world(n, n, lit(100.0), lit(200.0), lit(0.5), lit(-0.25))
    px, py = C.world_to_pixel(q, q, lit(3.0), lit(9.0), lit(0.5), lit(-0.25))
    w, h = C.scaled_size(lit(0.37), F.col("l_partkey"), F.col("l_suppkey"), lit(1), lit(1))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", wx.alias("wx"), wy.alias("wy"), px.alias("px"), py.alias("py"), C.patch_pixels(F.col("l_extendedprice"), lit(-1e-6) * n).alias("patch"), w.alias("w"), h.alias("h"), C.blend(F.col("l_tax"), F.col("l_discount")).alias("blended"))


@query("SELECT event_id, event_type || '_' || (user_id % 7) || '_' || event_id AS result_key, 'site' AS clsname, CASE user_id % 2 WHEN 0 THEN 0 ELSE 255 END * 12 AS mask_sum FROM events")
def result_keys(spark, sf_dir):
    path = F.concat(F.lit("root/site/test/"), F.col("user_id") % 7, F.lit("/"), F.col("event_id"), F.lit(".npy"))
    total = F.aggregate(C.constant_mask((F.col("user_id") % 2).cast("int"), F.lit(3), F.lit(4)), F.lit(0), lambda s, v: s + v)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", C.result_key(F.col("event_type"), path).alias("result_key"), C.path_class(path).alias("clsname"), total.alias("mask_sum"))


@query("SELECT vec_id AS tile_id, round((2 * embedding[1] + embedding[2])::DOUBLE, 5) AS two, round((3 * embedding[1])::DOUBLE, 5) AS one, round((embedding[1] + embedding[2] + embedding[3])::DOUBLE, 5) AS three FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
def adapt_channels(spark, sf_dir):
    total = lambda k: F.round(F.aggregate(C.three_channels(F.slice("data", 1, k)), F.lit(0.0), lambda s, v: s + v), 5)
    return demo.tiles(spark, sf_dir).select("tile_id", total(2).alias("two"), total(1).alias("one"), total(5).alias("three"))


@query("WITH " + TILES_SQL + " SELECT tile_id, round(sum((p.i + y * 8 + x + 1) * v * (1 + p.i)), 3) AS digest, 128 AS n FROM cells, (SELECT 0 AS i UNION ALL SELECT 64 * 0 + 1) p GROUP BY tile_id")
def stack_layers(spark, sf_dir):
    tiles = demo.tiles(spark, sf_dir).select("tile_id", "data")
    twice = T.stack_layers([tiles, tiles.withColumn("data", F.transform("data", lambda v: 2 * v))], "tile_id")
    digest = F.aggregate(F.transform("data", lambda v, k: v * (k % 64 + 1 + F.when(k >= 64, 1).otherwise(0))), F.lit(0.0), lambda s, v: s + v)
    return twice.select("tile_id", F.round(digest, 3).alias("digest"), F.size("data").alias("n"))


@query("WITH " + SCORES_SQL + " SELECT s.tile_id, s.clsname, s.score, o.o_custkey AS pred FROM scores s JOIN orders o ON o.o_orderkey = s.tile_id")
def zip_results(spark, sf_dir):
    scores = demo.scores(spark, sf_dir).withColumnRenamed("tile_id", "result_key")
    pred = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("result_key"), F.col("o_custkey").alias("pred"))
    return E.zip_results(scores.select("result_key", "clsname"), pred, scores.select("result_key", "score")).withColumnRenamed("result_key", "tile_id")


@query("WITH " + RASTER_SQL + " SELECT raster_id, y, x, v AS a, v AS b FROM raster")
def concat_features(spark, sf_dir):
    cells = demo.raster(spark, sf_dir)
    return rounded(G.concat_features([cells, cells], 64, 64).select("raster_id", "y", "x", F.col("feat")[0].alias("a"), F.col("feat")[1].alias("b")), "a", "b")


@query("WITH " + ROC_SQL + ", " + YOUDEN_SQL + ", " + COUNTS_SQL + " SELECT round(avg((tp + tn) / (tp + fp + fn + tn)), 6) AS mean_accuracy FROM counts")
def class_accuracy_mean(spark, sf_dir):
    scores = demo.scores(spark, sf_dir)
    return rounded(E.class_accuracy_mean(E.classification_metrics(scores, E.youden_threshold(scores, "clsname"), "clsname")), "mean_accuracy")


@query("WITH " + TEST_SQL + " SELECT clsname, orchard, tile_id, label FROM meta")
def order_test_rows(spark, sf_dir):
    return D.order_test_rows(_test_metadata(spark, sf_dir), "tile_id").select("clsname", "orchard", "tile_id", "label")


@query("WITH " + TILES_SQL + " SELECT tile_id, md5(tile_id || '|seed') AS place FROM tiles")
def shuffle(spark, sf_dir):
    return D.shuffle(demo.tiles(spark, sf_dir), "tile_id", SEED).select("tile_id", D.draw(F.col("tile_id"), SEED).alias("place"))


@query("WITH " + SPLIT_SQL + ", n AS (SELECT orchard FROM split WHERE split = 'test' AND case_ = 'normal') SELECT tile_id, orchard IN (SELECT orchard FROM n) AS has_normals FROM split WHERE split = 'test' AND case_ <> 'normal'")
def cases_and_normals(spark, sf_dir):
    split = D.train_test_split(demo.tiles(spark, sf_dir), "tile_id", SEED)
    one = D.cases_with_normals(split).select("tile_id", F.lit(True).alias("has_normals"))
    return one.unionByName(D.cases_without_normals(split).select("tile_id", F.lit(False).alias("has_normals")))


@query("WITH " + MASK_SQL + " " + BOX_SQL.format(f="max", t="mask", lo=3, hi=3))
def buffer_mask(spark, sf_dir):
    return M.buffer_mask(demo.mask(spark, sf_dir), 3)


@query()
def prepare_training(spark, sf_dir):
    from orthospark.plans.pipelines import training_tiles

    cells, on = demo.raster(spark, sf_dir), demo.mask(spark, sf_dir)
    kind = F.when(on["v"] == 0, -999).otherwise(1 + cells["v"].cast("int") % 3)
    mask = cells.join(on, ["raster_id", "y", "x"]).select("raster_id", "y", "x", kind.alias("mask"))
    ref = cells.select("raster_id", "y", "x", F.lit(0.0).alias("ref"))
    _, scaled = training_tiles(cells.withColumn("b", F.lit(0)), mask, ref, 64, 64, 8, 2, 0.2, SEED)
    return rounded(T.map_scores(scaled, "tile_id", "case", "split"), "score")


@query()
def reconstruction_scores(spark, sf_dir):
    from orthospark.operators import scoring

    tiles = demo.tiles(spark, sf_dir)
    rebuilt = scoring.reconstruct(tiles, scoring.fit_reconstruction(tiles.where("case = 'normal'"), 8))
    return rounded(rebuilt.select("tile_id", "case", "mse", "distance"), "mse", "distance", places=4)
