"""Evaluation of scores per class: curves, thresholds, metrics and site verdicts.

``scores`` has a label (1: defective), a score and any grouping columns; every operator works on all groups in one
plan. Null and NaN scores, and null labels, are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthospark.functions.columns import percent, verdict

#: Cuts between the blocks in which a group's distinct scores are summed, and parts in which they meet the cuts.
CUTS, PARTS = 255, 64
#: Quantiles of a group's scores between the blocks of :func:`curve_facts`, and the parts in which they meet.
QUANTILES, DEALT = 63, 16

#: Scores of a map by name: a Column over the array ``map``.
ENCODERS: dict[str, Callable[[Column], Column]] = {}


def register_encoder(name: str, encode: Callable[[Column], Column]) -> None:
    ENCODERS[name] = encode


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a))


register_encoder("mean", _mean)
register_encoder("std", lambda a: F.sqrt(_mean(F.transform(a, lambda v: (v - _mean(a)) * (v - _mean(a))))))
register_encoder("max", F.array_max)


def encode(maps: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """keys, metric, score of the array column ``map`` for each named encoder."""
    return maps.select(*keys, *[ENCODERS[n](F.col("map")).alias(n) for n in names]).unpivot(list(keys), names, "metric", "score")


def _clean(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))


def zip_results(info: DataFrame, pred: DataFrame, mask: DataFrame, key: str = "result_key") -> DataFrame:
    return info.join(pred, key).join(mask, key)


def orient_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Scores turned to (largest - score) in groups whose defective ones score lower on average; adds inverted and max_score."""
    sides = _clean(scores).groupBy(*by).agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("__bad"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("__good"), F.max("score").alias("max_score"))
    turned = sides.select(*by, F.coalesce(F.col("__bad") < F.col("__good"), F.lit(False)).alias("inverted"), "max_score")
    return _clean(scores).join(turned, list(by)).withColumn("score", F.when(F.col("inverted"), F.col("max_score") - F.col("score")).otherwise(F.col("score")))


def _met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """``left`` with the other columns of ``right``; null keys meet null keys."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return left.join(other, same).drop(*[f"__r_{c}" for c in on])


def _running(counted: DataFrame, score: str, sums: tuple[str, ...], *by: str) -> DataFrame:
    """``counted`` (a row a group and score) with upto_<x>, the sum of x over the group's rows of this score or a higher one,
    and all_<x>, for each x of ``sums``.

    No task orders a whole group: its scores are cut into blocks at the ``CUTS`` scores of least hash, so blocks hold about
    as many scores each and come out the same whenever they are worked out; a block's sums start at those of the blocks above."""
    drawn = counted.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(score), score))).where(F.col("__n") <= CUTS)
    cuts = drawn.groupBy(*by).agg(F.collect_list(score).alias("__cuts")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = _met(counted.withColumn("__part", F.pmod(F.xxhash64(score), F.lit(PARTS)).cast("int")), cuts, *by, "__part")
    rows = dealt.withColumn("__block", F.size(F.filter("__cuts", lambda c: c > F.col(score)))).drop("__cuts", "__part")
    above = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "__block").agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    starts = blocks.select(*by, "__block", *[F.coalesce(F.sum(f"__{x}").over(above), F.lit(0)).alias(f"__above_{x}") for x in sums], *[F.sum(f"__{x}").over(Window.partitionBy(*by)).alias(f"all_{x}") for x in sums])
    inside = Window.partitionBy(*by, "__block").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return _met(rows, starts, *by, "__block").withColumns({f"upto_{x}": F.col(f"__above_{x}") + F.sum(x).over(inside) for x in sums}).drop("__block", *[f"__above_{x}" for x in sums])


def _steps(scores: DataFrame, *by: str) -> DataFrame:
    """Per distinct score: threshold, pos, neg, tp, fp, p, n."""
    counted = _clean(scores).groupBy(*by, F.col("score").cast("double").alias("threshold")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    return _running(counted, "threshold", ("pos", "neg"), *by).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp", "all_pos": "p", "all_neg": "n"})


def roc_curve(scores: DataFrame, *by: str) -> DataFrame:
    """A point for each distinct score, highest first, and the origin at infinity: threshold, tp, fp, p, n, tpr, fpr."""
    points = _steps(scores, *by).select(*by, "threshold", "tp", "fp", "p", "n")
    zero = F.lit(0).cast("long")
    origin = _clean(scores).groupBy(*by).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).select(*by, F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"), "p", "n")
    if not by:
        origin = origin.where("p IS NOT NULL")
    return points.unionByName(origin).withColumn("tpr", F.try_divide(F.col("tp"), F.col("p"))).withColumn("fpr", F.try_divide(F.col("fp"), F.col("n")))


def _facts(scores: DataFrame, *by: str) -> DataFrame:
    """p, n, inverted, max_score and cuts (about the quantiles, the highest first) of each group, in one aggregation."""
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("score")))
    at = F.array(*[F.lit((QUANTILES + 1 - i) / (QUANTILES + 1)) for i in range(1, QUANTILES + 1)])
    facts = _clean(scores).groupBy(*by).agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"), F.max("score").alias("max_score"), F.coalesce(side(1) < side(0), F.lit(False)).alias("inverted"),
        F.percentile_approx(F.col("score").cast("double"), at, F.lit(1000)).alias("__cuts"),
    )
    return facts.where("p IS NOT NULL")


def curve_facts(scores: DataFrame, *by: str, orient: bool = False) -> DataFrame:
    """Everything that is read off a group's curve, from two readings of the scores: p, n, inverted, max_score, area (null for groups of one
    label), and threshold, tp, fp of the point with the largest tpr - fpr, the highest threshold of equals (infinite where no score
    beats the origin). With ``orient``, of the scores that :func:`orient_scores` gives.

    A group's distinct scores are counted, and summed from the highest down in blocks between its quantiles, so that no task orders a
    whole group. What counts of a block is how many it holds, its area above its own first count, and its best point:
    the counts of the blocks above shift these, they don't change them. So the blocks, not the scores, are put together."""
    facts = _facts(scores, *by)
    counted = _clean(scores).groupBy(*by, F.col("score").cast("double").alias("score")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    dealt = facts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = _met(counted.withColumn("__part", F.pmod(F.xxhash64("score"), F.lit(DEALT)).cast("int")), dealt, *by, "__part")
    turn = F.col("inverted") & F.lit(orient)
    # Of a turned group the blocks are turned too: what is above lies below.
    above = F.size(F.filter("__cuts", lambda c: F.when(turn, c < F.col("score")).otherwise(c > F.col("score"))))
    turned = F.when(turn, F.col("max_score").cast("double") - F.col("score")).otherwise(F.col("score"))
    facts_of = ["p", "n", "inverted", "max_score"]
    # Turning may round two scores to one. Rows are dealt by block, and stay there for the window.
    placed = met.select(*by, above.alias("__block"), turned.alias("score"), "pos", "neg", *facts_of).repartition(*by, "__block")
    steps = placed.groupBy(*by, "__block", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[F.first(c).alias(c) for c in facts_of])
    down = Window.partitionBy(*by, "__block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("t", F.sum("pos").over(down)).withColumn("f", F.sum("neg").over(down))
    real = lambda c: F.col(c).cast("double")
    gain = lambda t, f: t * real("n") - f * real("p")
    blocks = steps.groupBy(*by, "__block").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(real("neg") * (real("t") - real("pos") / 2)).alias("area"), F.max(F.struct(gain(real("t"), real("f")).alias("gain"), "score", "t", "f")).alias("best"),
        *[F.first(c).alias(c) for c in facts_of],
    )
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # QUANTILES + 1 rows a group
    blocks = blocks.withColumn("t0", F.coalesce(F.sum("pos").over(earlier), F.lit(0))).withColumn("f0", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    best = F.struct((gain(real("t0"), real("f0")) + F.col("best.gain")).alias("gain"), F.col("best.score").alias("threshold"), (F.col("t0") + F.col("best.t")).alias("tp"), (F.col("f0") + F.col("best.f")).alias("fp"))
    origin = F.struct(F.lit(0.0).alias("gain"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    groups = blocks.groupBy(*by).agg(*[F.first(c).alias(c) for c in facts_of], F.sum(real("t0") * real("neg") + F.col("area")).alias("area"), F.max(best).alias("best"))
    found = groups.withColumn("best", F.greatest("best", origin)).withColumn("area", F.try_divide(F.col("area"), real("p") * real("n")))
    return (found if by else found.where("p IS NOT NULL")).select(*by, *facts_of, "area", "best.threshold", "best.tp", "best.fp")


def _folded(area: Column) -> Column:
    return F.when(area < 0.5, 1 - area).otherwise(area)


def auroc(scores: DataFrame, *by: str, fold: bool = True) -> DataFrame:
    """Area under the curve by trapezoids; with ``fold``, an area below one half counts from the other side.
    Null for groups of one label."""
    return curve_facts(scores, *by).select(*by, (_folded(F.col("area")) if fold else F.col("area")).alias("auroc"))


def auroc_by_rank(scores: DataFrame, *by: str) -> DataFrame:
    """The same area from average ranks (Mann and Whitney)."""
    wins = F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)
    sums = _steps(scores, *by).groupBy(*by).agg(F.sum(wins).alias("w"), F.max("p").alias("p"), F.max("n").alias("n"))
    return sums.select(*by, F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auroc"))


def pixel_auroc(cells: DataFrame, *by: str) -> DataFrame:
    """Area over all cells; those with a mask above 0 are the positives."""
    return auroc(cells.select(*by, F.when(F.col("mask") > 0, 1).otherwise(0).alias("label"), F.col("pred").alias("score")), *by)


def youden_threshold(scores: DataFrame, *by: str) -> DataFrame:
    """The score with the largest tpr - fpr, the highest of equals; infinite where no score beats the origin."""
    return curve_facts(scores, *by).select(*by, "threshold")


def _metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}


def classification_metrics(scores: DataFrame, thresholds: DataFrame, *by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of score >= threshold; 0 where a ratio has nothing below."""
    hit = F.col("score") >= F.col("threshold")
    c = _clean(scores).join(thresholds, list(by)).groupBy(*by).agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"), F.count_if(~hit & (F.col("label") == 0)).alias("tn")
    )
    return c.select(*by, *[m.alias(k) for k, m in _metrics(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()])


def confusion_matrix(scores: DataFrame, thresholds: DataFrame, *by: str) -> DataFrame:
    """Counts for every label and prediction, 0 where there are none."""
    rows = _clean(scores).join(thresholds, list(by)).select(*by, F.col("label").cast("int").alias("label"), (F.col("score") >= F.col("threshold")).cast("int").alias("pred"))
    counts = rows.groupBy(*by).agg(*[F.count_if((F.col("label") == a) & (F.col("pred") == b)).alias(f"{a}{b}") for a in (0, 1) for b in (0, 1)])
    grid = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])
    return counts.select(*by, F.inline(grid))


def class_accuracy_mean(accuracies: DataFrame, value: str = "accuracy") -> DataFrame:
    return accuracies.agg(F.avg(value).alias("mean_accuracy"))


def _raw_threshold() -> Column:
    return F.when(F.col("inverted"), F.col("max_score") - F.col("threshold")).otherwise(F.col("threshold"))


def thresholds_table(oriented: DataFrame, *by: str) -> DataFrame:
    """threshold in the oriented scores, and raw_threshold in those as given."""
    facts = oriented.groupBy(*by).agg(F.bool_or("inverted").alias("inverted"), F.max("max_score").alias("max_score"))
    return youden_threshold(oriented, *by).join(facts, list(by)).withColumn("raw_threshold", _raw_threshold())


def evaluate(scores: DataFrame, *by: str) -> DataFrame:
    """Everything per group (class and metric, say): auroc, threshold, inverted, max_score, raw_threshold, accuracy, precision, recall, f1. The scores are read twice."""
    c = F.col
    metrics = _metrics(c("tp"), c("fp"), c("p") - c("tp"), c("n") - c("fp"))
    return curve_facts(scores, *by, orient=True).select(*by, _folded(c("area")).alias("auroc"), "threshold", "inverted", "max_score", _raw_threshold().alias("raw_threshold"), *[m.alias(k) for k, m in metrics.items()])


def macro_mean(metrics: DataFrame, metric: str = "metric") -> DataFrame:
    """Unweighted mean area over classes, a row a metric, named mean_<metric>_auc."""
    return metrics.groupBy(metric).agg(F.avg("auroc").alias("value")).select(F.concat(F.lit("mean_"), F.col(metric), F.lit("_auc")).alias("name"), "value")


def metric_report(metrics: DataFrame, names: list[str], cls: str = "clsname", metric: str = "metric") -> DataFrame:
    """A row a class and a column a metric, with the row ``mean`` last (place 1)."""
    table = metrics.where(F.col(cls) != "mean").groupBy(cls).pivot(metric, names).agg(F.first("auroc"))
    mean = table.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("mean").alias(cls), *names)
    return table.withColumn("place", F.lit(0)).unionByName(mean.withColumn("place", F.lit(1)))


def score_histogram(scores: DataFrame, bins: int, *by: str) -> DataFrame:
    """Counts in equal bins, each label over its own range; the last bin is closed."""
    limits = _clean(scores).groupBy(*by, "label").agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    at = F.coalesce(F.floor(F.try_divide(F.col("score") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(0))
    return _clean(scores).join(limits, [*by, "label"]).groupBy(*by, "label", F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean, median, deviation, least and largest of all scores (group all), and of each label's. The median is that of
    the two middle places in the running counts of distinct scores."""
    rows = _clean(scores).withColumn("group", F.explode(F.array(F.lit("all"), F.when(F.col("label") == 1, "defective").otherwise("good"))))
    placed = _running(rows.groupBy("group", F.col("score").cast("double").alias("score")).agg(F.count("*").alias("k")), "score", ("k",), "group")
    at = lambda place: F.max(F.when((F.col("upto_k") - F.col("k") < place) & (place <= F.col("upto_k")), F.col("score")))
    medians = placed.groupBy("group").agg((at(F.floor((F.col("all_k") + 1) / 2)) * 0.5 + at(F.floor(F.col("all_k") / 2) + 1) * 0.5).alias("median"))
    moments = rows.groupBy("group").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    return moments.join(medians, "group").select("group", "mean", "median", "std", "min", "max")


def k_mean(scores: DataFrame, k: int, by: str, largest: bool, name: str) -> DataFrame:
    """Mean of up to k largest or smallest scores of each group."""
    w = Window.partitionBy(by).orderBy(F.desc("score") if largest else F.asc("score"))
    return scores.where(F.col("score").isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy(by).agg(F.avg("score").alias(name))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, lower: str = "all_case_1", upper: str = "all_case_2", space: str = "reference") -> DataFrame:
    """Scores with one lower and one upper limit, and their verdict; thresholds: clsname, threshold. ``space`` raw takes
    raw_threshold, for scores that weren't turned."""
    at = F.col({"reference": "threshold", "raw": "raw_threshold"}[space])
    limits = thresholds.agg(F.max(F.when(F.col("clsname") == lower, at)).alias("lower"), F.max(F.when(F.col("clsname") == upper, at)).alias("upper"))
    return scores.crossJoin(F.broadcast(limits)).withColumn("verdict", verdict(F.col("score"), F.col("lower"), F.col("upper")))  # limits: one row


def class_rollup(judged: DataFrame, by: str = "clsname", k: int = 5) -> DataFrame:
    """Per site: counts and percentages of verdicts, mean, and the means of the k highest and lowest scores."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    base = judged.where(F.col("score").isNotNull()).groupBy(by).agg(F.count("*").alias("total"), n("Normal").alias("n_normal"), n("below").alias("n_below"), n("above").alias("n_above"), F.avg("score").alias("mean"))
    share = lambda c: F.col(c) * 100.0 / F.col("total")
    base = base.withColumns({"pct_below": share("n_below"), "pct_above": share("n_above")}).withColumn("anomalous_pct", (F.col("n_below") + F.col("n_above")) * 100.0 / F.col("total"))
    return base.join(k_mean(judged, k, by, True, "top5"), by).join(k_mean(judged, k, by, False, "bottom5"), by)


def classify_site(rollup: DataFrame) -> DataFrame:
    """Points for either case, the verdict (Anomalous beyond one point) and its reasons."""
    # Limits, points and sentences of the usual verdict.
    c, point = F.col, lambda n, when: F.when(when, n).otherwise(0)
    one = point(2, c("bottom5") < 21) + point(2, c("pct_below") > 10) + point(1, c("anomalous_pct") > 50)
    two = point(2, c("pct_above") > 15) + F.when(c("top5") > 75, 2).when(c("top5") > 70, 1).otherwise(0) + point(1, c("mean") > 50) + point(1, c("anomalous_pct") > 50)
    scored = rollup.withColumn("points_1", one).withColumn("points_2", two)
    reasons = F.array(
        F.when(c("mean") > 45, "High overall anomaly score"),
        F.when(c("points_1") > c("points_2") + 2, "High Case 1, low Case 2").when(c("points_2") > c("points_1") + 2, "High Case 2, low Case 1"),
        F.when(c("top5") - c("bottom5") > 40, "Wide range of anomaly scores"),
        F.when(c("top5") > 70, "High top 5 average"),
        F.when(c("bottom5") < 21, "Low bottom 5 average"),
    )
    said = F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ", ")
    return scored.withColumn("site_verdict", F.when(c("points_1") + c("points_2") > 1, "Anomalous").otherwise("Normal")).withColumn("insights", said)


def overall_rollup(judged: DataFrame, by: str = "clsname") -> DataFrame:
    """Verdict counts of each site and of all (site null), with shares as text."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    total = judged.where(F.col("verdict").isNotNull()).rollup(by).agg(F.count("*").alias("total"), n("Normal").alias("n_normal"), n("below").alias("n_below"), n("above").alias("n_above"))
    return total.withColumns({f"share_{v}": percent(F.col(f"n_{v}"), F.col("total")) for v in ("normal", "below", "above")})
