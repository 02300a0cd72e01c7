import math
import random
import re
import statistics

import pytest

from orthospark.operators import evaluate as E

A = [(0, 10.0), (0, 20.0), (0, 30.0), (0, 40.0), (1, 35.0), (1, 50.0), (1, 60.0), (1, 60.0)]
B = [(0, 40.0), (0, 50.0), (0, 55.0), (0, 60.0), (1, 10.0), (1, 20.0), (1, 30.0), (1, 45.0)]
C = [(0, 70.0), (0, 80.0), (1, 20.0), (1, 30.0)]


def table(spark, sets):
    return spark.createDataFrame([(k, label, s) for k, rows in sets.items() for label, s in rows], "clsname string, label int, score double")


def test_evaluate_golden_sets(spark):
    got = {r.clsname: r for r in E.evaluate(table(spark, {"A": A, "B": B, "C": C}), "clsname").collect()}
    a, b, c = got["A"], got["B"], got["C"]
    assert (a.inverted, a.auroc, a.threshold, a.raw_threshold) == (False, 0.9375, 50.0, 50.0)
    assert (a.accuracy, a.precision, a.recall) == (0.875, 1.0, 0.75)
    assert (b.inverted, b.auroc, b.threshold, b.raw_threshold) == (True, 0.9375, 30.0, 30.0)
    assert (c.inverted, c.auroc, c.threshold, c.raw_threshold) == (True, 1.0, 50.0, 30.0)


def test_degenerate_groups(spark):
    scores = table(spark, {"one": [(1, 1.0), (1, 2.0)], "flat": [(0, 5.0), (1, 5.0)]})
    area = {r.clsname: r.auroc for r in E.auroc(scores, "clsname").collect()}
    assert area == {"one": None, "flat": 0.5}
    assert {r.clsname: r.threshold for r in E.youden_threshold(scores, "clsname").collect()}["flat"] == math.inf


def test_nulls_and_nans_are_left_out(spark):
    dirty = table(spark, {"A": [*A, (None, 99.0), (1, None), (0, math.nan)]})
    assert E.auroc(dirty, "clsname").first().auroc == 0.9375
    assert E.auroc(dirty.where("score > 1000"), "clsname").count() == 0


def test_rank_form_equals_trapezoids(spark):
    rows = [(k, (i * 7 + k) % 2, float((i * i * 13 + k) % 17)) for k in range(3) for i in range(60)]
    scores = spark.createDataFrame(rows, "clsname long, label long, score double")
    one = {r.clsname: r.auroc for r in E.auroc(scores, "clsname", fold=False).collect()}
    two = {r.clsname: r.auroc for r in E.auroc_by_rank(scores, "clsname").collect()}
    assert one == pytest.approx(two)


SITES = {
    "O1": [40, 42, 44, 45, 46, 48],
    "O2": [15, 18, 20, 22, 25, 40, 50, 55],
    "O3": [45, 50, 72, 74, 76, 80, 82],
    "O4": [36, 40, 41],
    "edge": [35, 60],
}


def test_site_verdicts(spark):
    scores = spark.createDataFrame([(k, float(s)) for k, v in SITES.items() for s in v], "clsname string, score double")
    limits = spark.createDataFrame([("all_case_1", 35.0), ("all_case_2", 60.0)], "clsname string, threshold double")
    judged = E.apply_thresholds(scores, limits)
    got = {r.clsname: r for r in E.classify_site(E.class_rollup(judged)).collect()}
    assert [got[k].site_verdict for k in ("O1", "O2", "O3", "O4")] == ["Normal", "Anomalous", "Anomalous", "Normal"]
    assert got["O2"].insights == "High Case 1, low Case 2, Low bottom 5 average"
    assert got["O3"].insights == "High overall anomaly score, High Case 2, low Case 1, High top 5 average"
    assert [(got[k].points_1, got[k].points_2) for k in ("O1", "O2", "O3", "O4")] == [(0, 0), (5, 1), (1, 6), (0, 0)]
    assert got["O1"].top5 == 45 and got["O1"].bottom5 == pytest.approx(43.4) and got["O4"].top5 == 39
    assert got["edge"].n_normal == 2
    total = {r.clsname: r.total for r in E.overall_rollup(judged).collect()}
    assert total[None] == sum(map(len, SITES.values()))


def test_registry(spark):
    E.register_encoder("first", lambda a: a[0])
    maps = spark.createDataFrame([(1, [float(i) for i in range(16)])], "id int, map array<double>")
    got = {r.metric: r.score for r in E.encode(maps, ["mean", "std", "max", "first"], "id").collect()}
    assert got == pytest.approx({"mean": 7.5, "std": 4.6097722286464435, "max": 15.0, "first": 0.0})


@pytest.mark.parametrize("cuts", [1, 7, 255])
def test_curves_in_blocks(spark, monkeypatch, cuts):
    monkeypatch.setattr(E, "CUTS", cuts)
    monkeypatch.setattr(E, "PARTS", 3)
    rng = random.Random(cuts)
    rows = [(c, rng.randrange(2), float(rng.randrange(60)) / 8) for c in ("a", "b", None) for _ in range(150)] + [("one", 1, 2.0), ("one", 1, 3.0)]
    scores = spark.createDataFrame(rows, "clsname string, label int, score double")
    got = {(r.clsname, r.threshold): (r.tp, r.fp, r.p, r.n) for r in E.roc_curve(scores, "clsname").collect()}
    want, areas = {}, {}
    for c in ("a", "b", None, "one"):
        mine = [(y, s) for k, y, s in rows if k == c]
        p, n = sum(y for y, _ in mine), sum(1 - y for y, _ in mine)
        for t in {s for _, s in mine} | {math.inf}:
            want[c, t] = (sum(y for y, s in mine if s >= t), sum(1 - y for y, s in mine if s >= t), p, n)
        areas[c] = sum((s > z) + (s == z) / 2 for y, s in mine for x, z in mine if y > x) / (p * n) if p * n else None
    assert got == want
    for area in (E.auroc(scores, "clsname", fold=False), E.auroc_by_rank(scores, "clsname")):
        assert {r.clsname: r.auroc for r in area.collect()} == pytest.approx(areas)
    everything = E.roc_curve(scores.drop("clsname")).collect()
    assert {r.threshold: r.tp for r in everything} == {t: sum(y for _, y, s in rows if s >= t) for t in {s for _, _, s in rows} | {math.inf}}
    assert E.auroc(scores.drop("clsname")).first().auroc >= 0.5 and E.roc_curve(scores.drop("clsname").limit(0)).count() == 0
    summary = {r.group: r.median for r in E.score_summary(scores).collect()}
    assert summary == {g: statistics.median(s for _, y, s in rows if y in ys) for g, ys in {"all": (0, 1), "defective": (1,), "good": (0,)}.items()}


def test_no_task_orders_all_scores_of_a_class(spark):
    scores = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0)], "clsname string, label int, score double")
    plan = E.roc_curve(scores, "clsname")._jdf.queryExecution().optimizedPlan().toString()
    ordered = [w for w in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan) if "threshold" in w]
    drawn = [w for w in ordered if "__block" not in w]
    assert len(ordered) > len(drawn) == plan.count("WindowGroupLimit ")


def test_evaluate_reads_scores_twice(spark, tmp_path):
    """One aggregation for the facts of a group and one count of its scores; nothing orders a whole group."""
    table(spark, {"A": A, "B": B}).write.parquet(str(tmp_path / "scores"))
    plan = E.evaluate(spark.read.parquet(str(tmp_path / "scores")), "clsname")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    windows = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", plan)
    assert windows and all("__block" in w for w in windows)


def test_evaluate_against_brute_force(spark):
    """Many scores with ties, turned groups, more scores than blocks, groups of one label, a null group."""
    rng = random.Random(6)
    sets = {"up": [(y, round(rng.gauss(50 + 8 * y, 12), 1)) for y in (0, 1) for _ in range(700)], "down": [(y, round(rng.gauss(50 - 9 * y, 12), 1)) for y in (0, 1) for _ in range(400)]}
    sets |= {"few": [(0, 1.0), (1, 1.0), (1, 2.0)], "good": [(0, 3.0), (0, 4.0)], None: [(0, 1.0), (1, 7.0)]}
    got = {r.clsname: r for r in E.evaluate(table(spark, sets).repartition(3), "clsname").collect()}
    assert set(got) == set(sets)
    for k, rows in sets.items():
        bad, good = [s for y, s in rows if y], [s for y, s in rows if not y]
        top = max(s for _, s in rows)
        turned = bool(bad and good) and sum(bad) / len(bad) < sum(good) / len(good)
        rows = [(y, top - s if turned else s) for y, s in rows]
        bad, good = [s for y, s in rows if y], [s for y, s in rows if not y]
        r = got[k]
        assert r.inverted == turned and r.max_score == top
        if not bad or not good:
            assert r.auroc is None and r.threshold == math.inf
            continue
        area = sum((a > b) + (a == b) / 2 for a in bad for b in good) / len(bad) / len(good)
        assert r.auroc == pytest.approx(max(area, 1 - area))
        best = max((sum(s >= t for s in bad) * len(good) - sum(s >= t for s in good) * len(bad), t) for t in {s for _, s in rows} | {math.inf})[1]
        assert r.threshold == best
        tp, fp = sum(s >= best for s in bad), sum(s >= best for s in good)
        assert (r.accuracy, r.recall) == pytest.approx(((tp + len(good) - fp) / len(rows), tp / len(bad)))
        assert r.f1 == pytest.approx(2 * tp / (tp + fp + len(bad)))
