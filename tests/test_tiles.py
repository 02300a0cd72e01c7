import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthospark.functions import columns as C
from orthospark.operators import grids, metadata, tiles, windows
from orthospark.sources.scratch import written


def grid(spark, a, **more):
    rows = [("r", y, x, v) for y, row in enumerate(a) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "raster_id string, y int, x int, v " + more.get("kind", "double"))


def array(df, value="v"):
    rows = df.collect()
    out = np.full((1 + max(r.y for r in rows), 1 + max(r.x for r in rows)), np.nan)
    for r in rows:
        out[r.y, r.x] = r[value] if r[value] is not None else np.nan
    return out


def test_tile_membership(spark):
    cells = grid(spark, np.zeros((10, 8)).tolist())
    got = tiles.assign_tiles(cells, 10, 8, 4, 1)
    assert got.count() == 96 and got.select("i", "j").distinct().count() == 6
    n = {(r.y, r.x): r["count"] for r in got.groupBy("y", "x").count().collect()}
    assert n[3, 3] == 4 and n[0, 0] == 1 and (0, 7) not in n
    with pytest.raises(ValueError):
        tiles.assign_tiles(cells, 10, 8, 4, 4)


def labels(spark, fill):
    mask = np.full((8, 8), -999)
    fill(mask)
    cells = grid(spark, mask.tolist(), kind="int").withColumnRenamed("v", "mask").withColumn("ref", F.lit(0.0))
    return tiles.assign_tiles(cells, 8, 8, 4, 0)


def test_tile_labels(spark):
    def fill(m):
        m[:4, :4].flat[:13] = 1
        m[0, 4] = 3
        m[4, 0] = 0
        m[4:, 4:] = 2
        m[:4, :4] = np.where(np.arange(16).reshape(4, 4) < 13, 1, -999)

    placed = labels(spark, fill)
    valid = placed.join(tiles.valid_tiles(placed, "i", "j"), ["i", "j"], "left_semi")
    case = lambda strict: {(r.i, r.j): r.case for r in tiles.classify_tiles(valid, 0.8, 16, "i", "j", strict=strict).collect()}
    assert case(False) == {(0, 0): "case_1", (0, 1): "normal", (1, 1): "case_2"}
    assert case(True) == {(0, 0): "case_1", (1, 1): "case_2"}


def test_percentiles_and_round_trip(spark):
    cells = spark.createDataFrame([(1, 0, i, 0, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 10.0])], "t int, y int, x int, b int, v double")
    p = tiles.tile_percentiles(cells, "t").first()
    assert (p.p1, p.p99) == pytest.approx((1.04, 9.76))
    tile = tiles.cells_to_tiles(cells, "t")
    assert tile.first().data == [1, 2, 3, 4, 10]
    assert sorted(map(tuple, tiles.tiles_to_cells(tile, "t").collect())) == sorted(map(tuple, cells.collect()))
    assert tiles.stack_layers([tile, tile.withColumn("data", F.array(F.lit(7.0)))], "t").first().data == [1, 2, 3, 4, 10, 7]


def test_map_encoders(spark):
    cells = grid(spark, np.arange(16.0).reshape(4, 4).tolist())
    got = {r.metric: r.score for r in tiles.map_scores(cells, "raster_id").collect()}
    assert got == pytest.approx({"mean": 7.5, "std": 4.6097722286464435})
    assert tiles.pooled_max(cells, 2, "raster_id").first().score == 12.5


def test_windows_golden(spark):
    row = grid(spark, [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0]])
    assert array(windows.dilate(row, 3, ["raster_id"]))[0].tolist() == [1, 2, 3, 4, 5, 5]
    assert array(windows.erode(row, 3, ["raster_id"]))[0].tolist() == [0, 0, 1, 2, 3, 4]
    pooled = {r.x: r.pooled for r in windows.box_mean(row, 1, 3, ["raster_id"], full_only=False).collect()}
    assert [pooled[x] for x in range(6)] == [None, 1, 2, 3, 4, None]


def test_duality_and_idempotence(spark):
    m = (np.random.default_rng(1).random((12, 9)) < 0.5).astype(int)
    cells = grid(spark, m.tolist(), kind="int")
    inverse = grids.mask_complement(cells)
    assert (array(windows.erode(cells, 3, ["raster_id"])) == 1 - array(windows.dilate(inverse, 3, ["raster_id"]))).all()
    once = windows.close(cells, 3, ["raster_id"])
    assert (array(once) == array(windows.close(once, 3, ["raster_id"]))).all()
    near = windows.l1_dilate(cells, 2, ["raster_id"])
    step = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    assert (array(near) == array(grids.neighbour_join(grids.neighbour_join(cells, step), step))).all()


def test_bilinear_keeps_planes(spark):
    a = np.add.outer(np.arange(6.0), 2 * np.arange(5.0))
    up = array(grids.resample_bilinear(grid(spark, a.tolist()), 11, 9, align_corners=True))
    assert up == pytest.approx(np.add.outer(np.linspace(0, 5, 11), 2 * np.linspace(0, 4, 9)))


def test_runs_golden(spark):
    steps = spark.createDataFrame([("a", i, float(v), n) for i, (v, n) in enumerate([(2, 1), (4, 1), (6, 2), (8, 4)])], "k string, step int, val double, num int")
    average = lambda df: [r.average for r in df.orderBy("step").collect()]
    assert average(windows.moving_average(steps, 2, ["k"], "step", "val")) == [2, 3, 5, 7]
    assert average(windows.running_weighted_mean(steps, ["k"], "step", "val", "num")) == [2, 3, 4.5, 6.25]
    runs = spark.createDataFrame([("m", 10, 0.90), ("m", 20, 0.95), ("m", 30, 0.95)], "k string, epoch int, v double")
    flags = lambda mode: [r.is_best for r in windows.running_best(runs, ["k"], "epoch", "v", mode).orderBy("epoch").collect()]
    assert flags(">=") == [True, True, True] and flags(">") == [True, True, False]


def test_split_sizes(spark):
    rows = [(i, "s", "normal") for i in range(40)] + [(100 + i, "s", "case_1") for i in range(6)] + [(200 + i, "s", "case_2") for i in range(15)]
    df = spark.createDataFrame(rows, "tile_id long, orchard string, `case` string")
    split = metadata.train_test_split(df, "tile_id", "x")
    n = {(r.case, r.split): r["count"] for r in split.groupBy("case", "split").count().collect()}
    assert n == {("normal", "train"): 30, ("normal", "test"): 10, ("case_1", "test"): 6, ("case_2", "test"): 15}
    meta = metadata.build_test_metadata(split, "tile_id", "x", totals=True)
    stats = {r.clsname: (r.defective, r.normal) for r in metadata.case_statistics(meta).collect()}
    assert stats == {"all_case_1": (6, 6), "all_case_2": (15, 10)}
    assert metadata.build_test_metadata(split, "tile_id", "x").count() == 2 * meta.count()
    assert metadata.cases_without_normals(split).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        C.result_key(F.lit("k"), F.lit("a/b/c.npy")).alias("key"), C.path_class(F.lit("w/x/y/z.npy")).alias("cls"), C.patch_pixels(F.lit(120.0), F.lit(-1e-6)).alias("px"),
        C.hsv(F.lit(0), F.lit(255), F.lit(0)).alias("hsv"), C.three_channels(F.array(F.lit(1), F.lit(2))).alias("three"), C.percent(F.lit(1), F.lit(3)).alias("share"),
        C.jitter(F.array(F.lit(1.0), F.lit(2.0)), F.lit(5), 0.0, 1.0, 7).alias("same"), C.minmax(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("flat"),
        C.turned(F.array(*[F.lit(i) for i in range(6)]), 2, 3, 1, "90").alias("turned"),
    ).first()
    assert (row.key, row.cls, row.px, tuple(row.hsv), row.three, row.share, row.same, row.flat) == ("k_b_c", "w", 120, (60, 255, 255), [1, 2, 1], "33.33%", [1.0, 2.0], None)
    assert row.turned == np.rot90(np.arange(6).reshape(2, 3)).ravel().tolist()
    with pytest.raises(Exception, match="neither"):
        spark.range(1).select(C.constant_mask(F.lit(2), F.lit(1), F.lit(1))).collect()
    assert math.isclose(spark.range(1).select(C.mean_square(F.array(F.lit(1.0)), F.array(F.lit(3.0)))).first()[0], 4)


def _ranked(rows, seed):
    return sorted(rows, key=lambda k: (hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), k))


def test_draws_of_one_large_site(spark):
    """All tiles at one site: who is drawn is as if the whole site had been ordered, and no window orders it."""
    rows = [(i, "only", ["case_1", "case_2", "case_3", *["normal"] * 17][i % 20]) for i in range(6000)]
    df = spark.createDataFrame(rows, "tile_id long, orchard string, case string").repartition(5)
    normals = [i for i, _, c in rows if c == "normal"]
    moved = set(_ranked(normals, "s")[:300])
    split = metadata.train_test_split(df, "tile_id", "s")
    assert {r.tile_id for r in split.where("case = 'normal' AND split = 'test'").collect()} == moved and split.count() == 6000
    for k in (0, 1, 1234, 9000):
        got = metadata.sample_k(df, ["orchard"], "tile_id", k, "q")
        assert {r.tile_id for r in got.collect()} == set(_ranked([i for i, *_ in rows], "q")[:k])
    test = metadata.build_test_metadata(split, "tile_id", "t")
    for name, site in (("all", "all"), ("site", "only")):
        got = {r.tile_id for r in test.where(f"clsname = '{site}_case_2' AND label = 0").collect()}
        assert got == set(_ranked(moved, f"t|{name}|case_2")[:300])
    few = metadata.sample_k(df, ["orchard"], "tile_id", 9, "q")
    windows = [w for df_ in (split, test, few) for w in re.findall(r"row_number\(\) windowspecdefinition\(([^)]*?) (?:ASC|DESC)", df_._jdf.queryExecution().executedPlan().toString())]
    assert windows and all("__bin" in w for w in windows) and few.count() == 9


def test_draws_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(i % 30, None if i % 2 else "a") for i in range(60)], "tile_id long, orchard string")
    got = metadata.sample_k(df, ["orchard"], "tile_id", 7, "q").collect()
    assert sorted((r.orchard or "", r.tile_id) for r in got) == sorted((s, k) for s in ("", "a") for k in sorted(_ranked([k for k, o in ((i % 30, "" if i % 2 else "a") for i in range(60)) if o == s], "q"), key=lambda k: (hashlib.md5(f"{k}|q".encode()).hexdigest(), k))[:7])
    assert metadata.sample_k(df.limit(0), ["orchard"], "tile_id", 7, "q").count() == 0


def test_regrid_shares_cells_by_area(spark):
    """Ratios that don't divide: each new cell is the mean of the area under it; the whole keeps its mean."""
    rng = np.random.default_rng(2)
    for (h, w), (to_h, to_w), (nh, nw) in (((7, 10), (3, 9), (3, 4)), ((5, 5), (4, 9), (4, 4)), ((6, 4), (9, 9), (6, 4)), ((9, 2), (3, 3), (3, 1)), ((1, 7), (5, 2), (1, 2))):
        a = rng.integers(0, 100, (h, w)).astype(float)
        across = lambda n, m: np.array([[max(0.0, min((i + 1) * m, (t + 1) * n) - max(i * m, t * n)) / n for i in range(n)] for t in range(m)])
        rows, columns = across(h, nh), across(w, nw)
        assert np.allclose(rows.sum(1), 1) and np.allclose(columns.sum(1), 1)
        got = array(grids.regrid(grid(spark, a.tolist()), to_h, to_w))
        assert got.shape == (nh, nw) and np.allclose(got, rows @ a @ columns.T)
        assert got.mean() == pytest.approx(a.mean())


def test_bilinear_in_two_passes(spark):
    """Against the four corners of each new cell, with and without aligned corners, up and down."""
    rng = np.random.default_rng(4)
    for (h, w), (nh, nw) in (((4, 6), (9, 5)), ((3, 3), (1, 7)), ((1, 5), (4, 4)), ((8, 8), (3, 3))):
        a = rng.random((h, w))
        for align in (False, True):
            def line(n, m):
                out = np.zeros((m, n))
                for t in range(m):
                    s = t * (n - 1) / max(m - 1, 1) if align else (t + 0.5) * n / m - 0.5
                    s = min(max(s, 0.0), n - 1.0)
                    out[t, int(s)] += 1 - (s - int(s))
                    out[t, min(int(s) + 1, n - 1)] += s - int(s)
                return out

            got = array(grids.resample_bilinear(grid(spark, a.tolist()), nh, nw, align))
            assert np.allclose(got, line(h, nh) @ a @ line(w, nw).T)


def test_sketches_keep_their_rank_error(spark):
    """Skewed values, many tiles: the ranks of what merged sketches give, against the exact ones."""
    rng = np.random.default_rng(11)
    values = {site: np.round(rng.lognormal(0, s, 60_000), 4) for site, s in (("a", 0.3), ("b", 2.0))}
    rows = [(site, i % 30, 0, float(v)) for site, vs in values.items() for i, v in enumerate(vs)]
    cells = spark.createDataFrame(rows, "orchard string, tile_id int, b int, v double").repartition(6)
    sketches = [tiles.site_sketches(cells.where(F.col("tile_id") % 3 == k)) for k in range(3)]
    merged = tiles.merged_sketches(sketches[0].unionByName(sketches[1]).unionByName(sketches[2]))
    for r in tiles.sketched_range(merged).collect():
        v = np.sort(values[r.orchard])
        for found, rank in ((r.lo, 0.01), (r.hi, 0.99)):
            assert np.searchsorted(v, found, "left") / len(v) - tiles.RANK_ERROR <= rank <= np.searchsorted(v, found, "right") / len(v) + tiles.RANK_ERROR
    assert max(len(r.sketch) for r in merged.collect()) < 100_000


def test_drawn_turns_in_one_pass(spark):
    """All flips and turns against numpy, two bands; the tile is gone through once, however many moves were drawn."""
    a = np.arange(18).reshape(3, 3, 2)
    rows = [(bool(h), bool(v), t, a.ravel().tolist()) for h in (0, 1) for v in (0, 1) for t in range(4)]
    df = spark.createDataFrame(rows, "h boolean, v boolean, turn int, data array<int>").select("h", "v", "turn", C.turned_as_drawn(F.col("data"), 3, 2, F.struct("h", "v", "turn")).alias("out"))
    got = df.collect()
    for r in got:
        flat = a[:, ::-1] if r.h else a
        flat = flat[::-1] if r.v else flat
        assert r.out == np.rot90(flat, r.turn).ravel().tolist()
    assert len(got) == 16
    assert df._jdf.queryExecution().analyzed().toString().count("lambdafunction(") == 2
    null = spark.range(1).select(C.turned_as_drawn(F.array(*[F.lit(k) for k in range(4)]), 2, 1, C.drawn_turns(F.lit(None).cast("long"), "s")).alias("out")).first()
    assert null.out == [0, 1, 2, 3]


def test_layers_are_not_broadcast(spark):
    """A table's files are far smaller than its rows."""
    layers = [written(grid(spark, np.zeros((4, 4)).tolist()).withColumnRenamed("v", name), name) for name in ("v", "mask", "ref")]
    met = tiles.colocate(*layers)
    assert met.count() == 16 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_nearest_without_looking_up(spark):
    """Up, down and at ratios that don't divide; no grid of targets is made, so none is broadcast."""
    rng = np.random.default_rng(6)
    for (h, w), (nh, nw) in (((4, 6), (9, 5)), ((3, 3), (1, 7)), ((1, 5), (4, 4)), ((8, 8), (3, 3)), ((64, 64), (100, 80))):
        a = rng.random((h, w))
        found = grids.resample_nearest(grid(spark, a.tolist()), nh, nw)
        assert found.count() == nh * nw
        assert (array(found) == a[np.arange(nh) * h // nh][:, np.arange(nw) * w // nw]).all()
    joins = re.findall(r"BroadcastHashJoin \[(.*?)\]", found._jdf.queryExecution().executedPlan().toString())
    assert all(re.sub(r"#\d+", "", keys) == "raster_id" for keys in joins)
