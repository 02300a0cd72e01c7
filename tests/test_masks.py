import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthospark.operators import graph as G
from orthospark.operators import masks as M
from orthospark.operators import regions as R
from orthospark.operators import windows as W
from orthospark.plans import demo
from orthospark.plans import pipelines as P
from orthospark.plans import region_queries  # noqa: F401  registers its queries
from orthospark.plans.demo_queries import QUERIES
from orthospark.sources.scratch import written

from test_tiles import array, grid


def mask(spark, text):
    return grid(spark, [[int(c == "#") for c in row] for row in text.split()], kind="int")


def test_corner_touch(spark):
    m = mask(spark, "#. .#")
    assert M.label_components(m, 4).select("comp_id").distinct().count() == 2
    assert M.label_components(m, 8).select("comp_id").distinct().count() == 1


def test_spiral_is_one_region(spark):
    a = np.zeros((15, 15), int)
    y = x = 0
    dy, dx, size = 0, 1, 15
    a[0, 0] = 1
    for leg in range(12):
        for _ in range(size - 1 if leg < 3 else size - 1 - 2 * ((leg - 1) // 2)):
            if not (0 <= y + dy < 15 and 0 <= x + dx < 15) or (0 <= y + 2 * dy < 15 and 0 <= x + 2 * dx < 15 and a[y + 2 * dy, x + 2 * dx]):
                break
            y, x = y + dy, x + dx
            a[y, x] = 1
        dy, dx = dx, -dy
    got = M.label_components(grid(spark, a.tolist(), kind="int").repartition(5), 4)
    assert got.select("comp_id").distinct().count() == 1 and got.count() == a.sum()


def test_props_and_holes(spark):
    for n, perimeter in ((3, 8), (5, 16)):
        p = M.region_props(M.label_components(grid(spark, np.pad(np.ones((n, n), int), 1).tolist(), kind="int"), 8)).first()
        assert (p.area, p.perimeter) == (n * n, perimeter)
        assert p.circularity == pytest.approx(4 * math.pi * n * n / perimeter**2)
    ring = np.pad(np.ones((5, 5), int), 1)
    ring[2:5, 2:5] = 0
    assert array(M.fill_holes(grid(spark, ring.tolist(), kind="int"))).sum() == 25
    full = grid(spark, np.ones((3, 3), int).tolist(), kind="int")
    assert array(M.fill_small_holes(full, 0.5)).sum() == 9


def test_cleaning(spark):
    two = mask(spark, "##..... ##..### ....### ....###")
    assert array(M.largest_component(two)).sum() == 9
    assert array(M.filter_regions(two, 0.9, 0.1)).sum() == 11  # closing reaches the near side
    nodata = two.select("raster_id", "y", "x", (F.col("x") < 3).alias("nodata"))
    assert array(M.drop_nodata_segments(two, nodata, 0.5, 3, 1)).sum() == 9
    bands = two.select("raster_id", "y", "x", F.lit(0).alias("b"), F.when(F.col("x") < 3, 1.0).otherwise((F.col("x") * F.col("y")).cast("double")).alias("v"))
    assert array(M.drop_low_variance_segments(two, bands, 0.5)).sum() == 9
    assert M.accept_raster(two, 0.4).first().accepted and array(M.buffer_mask(two, 1)).sum() > 13


def test_bridges(spark):
    bar = mask(spark, "......... .###.###. .#######. .###.###. .........")
    parts = M.split_weak_bridges(bar, 3, 0.2, 2)
    assert sorted(r["count"] for r in parts.groupBy("comp_id").count().collect()) == [9, 9]
    none = bar.select("raster_id", "y", "x", F.lit(False).alias("nodata"))
    assert array(M.keep_low_nodata_segments(bar, none, 1, most_width=3, least_share=0.2, depth=1)).sum() == 18
    some = none.withColumn("nodata", F.col("x") < 4)
    assert array(M.keep_low_nodata_segments(bar, some, 1, most_width=3, least_share=0.2, depth=1)).sum() == 9


def test_adaptive_close(spark):
    m = mask(spark, "##.## ##.## ##.##")
    assert array(M.adaptive_close(m, 0.1, 1)).sum() == 12  # one is very large: left as it is
    assert array(M.adaptive_close(m, 0.9, 1, (3,))).sum() >= 12


def test_candidates(spark):
    image = grid(spark, np.full((6, 6), 200.0).tolist())
    seg = spark.createDataFrame([("r", 1, y, x) for y in range(5) for x in range(5)] + [("r", 2, 5, 5)], "raster_id string, seg_id int, y int, x int")
    assert array(M.candidate_segments(seg, image, 0.5, 0.5)).sum() == 16  # the raster's sides don't erode


def test_no_region_at_all(spark):
    empty = grid(spark, np.zeros((3, 3), int).tolist(), kind="int")
    assert M.label_components(empty).count() == 0
    assert array(M.largest_component(empty)).sum() == 0 and array(M.fill_holes(empty)).sum() == 0


def flood(cells, touching):
    """Regions of a set of (raster_id, y, x), as sets."""
    left, found = set(cells), []
    while left:
        region, edge = set(), [left.pop()]
        while edge:
            r, y, x = edge.pop()
            region.add((r, y, x))
            near = {(r, y + dy, x + dx) for dy, dx in touching} & left
            left -= near
            edge += near
        found.append(region)
    return found


SIDES = [(-1, 0), (1, 0), (0, -1), (0, 1)]
ALL_ROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def test_region_queries_see_the_whole_mask(spark):
    where = "/root/testdata/sf0.001"
    cells = demo.mask(spark, where).collect()
    on = {(r.raster_id, r.y, r.x) for r in cells if r.v}
    value = {(r.raster_id, r.y, r.x): r.v for r in demo.raster(spark, where).collect()}

    areas = sorted((next(iter(g))[0], len(g)) for g in flood(on, ALL_ROUND))
    assert sorted((r.raster_id, r.area) for r in QUERIES["region_props"](spark, where).collect()) == areas

    spreads = {}
    for g in flood(on, SIDES):
        spreads.setdefault(next(iter(g))[0], []).append((round(float(np.std([float(value[c]) for c in g])), 9), g))
    kept = set()
    for found in spreads.values():
        stds = np.array([s for s, _ in found])
        z = (stds - stds.mean()) / (stds.std() or 1)
        kept |= set().union(*(g for k, (_, g) in zip(z, found, strict=True) if not k < -0.9))
    assert {(r.raster_id, r.y, r.x) for r in QUERIES["drop_low_variance_segments"](spark, where).collect() if r.v} == kept


def test_split_query_sees_the_whole_mask(spark):
    where = "/root/testdata/sf0.001"
    cells = demo.mask(spark, where).collect()
    places, on = {(r.raster_id, r.y, r.x) for r in cells}, {(r.raster_id, r.y, r.x) for r in cells if r.v}
    grown = {(r, y + dy, x + dx) for r, y, x in on for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & places
    parts, wholes = {}, {}
    for r in QUERIES["split_weak_bridges"](spark, where).collect():
        parts.setdefault(r.raster_id, []).append(r.area)
    for g in flood(grown, ALL_ROUND):
        wholes.setdefault(next(iter(g))[0], []).append(len(g))
    assert parts.keys() == wholes.keys()
    for r, areas in parts.items():
        # Cutting a bridge leaves more parts and may lose its cells.
        assert sorted(areas) == sorted(wholes[r]) or len(areas) > len(wholes[r]) and sum(areas) <= sum(wholes[r])


def random_mask(seed, h, w, share):
    return (np.random.default_rng(seed).random((h, w)) < share).astype(int)


@pytest.mark.parametrize(("conn", "touching"), [(4, SIDES), (8, ALL_ROUND)])
def test_blocks_of_every_size_give_the_same_regions(spark, conn, touching):
    for share, block in ((0.45, 1), (0.55, 4), (0.5, 7), (0.6, 256)):
        a = random_mask(conn + block, 23, 30, share)
        got = R.label_components(grid(spark, a.tolist(), kind="int").repartition(3), conn, block=block).collect()
        wanted = {}
        for region in flood({("r", y, x) for y, x in zip(*np.nonzero(a), strict=True)}, touching):
            wanted |= dict.fromkeys(region, min(y * 30 + x for _, y, x in region))
        assert {("r", r.y, r.x): r.comp_id for r in got} == {(k, int(y), int(x)): int(v) for (k, y, x), v in wanted.items()}


def test_edges_follow_the_seams(spark):
    """A full mask has one region a block: an edge for each two blocks side by side (or corner to corner), whatever their area."""
    for size, block in ((32, 8), (64, 16)):
        m = grid(spark, np.ones((size, size), int).tolist(), kind="int")
        for conn, edges in ((4, 24), (8, 24 + 18)):
            regions = R.block_regions(m, conn, ["raster_id"], block)
            assert R.seams(regions, conn, ["raster_id"], block).count() == edges
    assert R.seams(R.block_regions(m, 8, ["raster_id"], 64), 8, ["raster_id"], 64).count() == 0


def test_blocks_across_batches(spark):
    """Blocks that don't end where a batch does, null keys among them, and a cell that stands there twice."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, y, x, 1) for k in ("a", "b") for y in range(9) for x in range(9) if (y + x) % 4] + [("a", 0, 1, 1)]
        got = R.label_components(spark.createDataFrame(rows, "raster_id string, y int, x int, v int"), 4, block=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cells = {(k, y, x) for k, y, x, _ in rows}
    wanted = {c: min(y * 9 + x for _, y, x in g) for g in flood(cells, SIDES) for c in g}
    assert {(r.raster_id, r.y, r.x): r.comp_id for r in got} == wanted and len(got) == len(rows)


def test_levels_of_the_distance_are_the_erosions(spark):
    a = random_mask(5, 20, 26, 0.93)
    m = grid(spark, a.tolist(), kind="int")
    far = {(r.y, r.x): r.distance for r in W.chessboard_distance(m, 4, ["raster_id"]).collect()}
    assert set(far) == {(int(y), int(x)) for y, x in zip(*np.nonzero(a), strict=True)}
    for r in range(1, 5):
        eroded = {(int(y), int(x)) for y, x in zip(*np.nonzero(array(W.erode(m, 2 * r + 1, ["raster_id"]))), strict=True)}
        assert {c for c, d in far.items() if d > r} == eroded
    sparse = grid(spark, random_mask(6, 20, 26, 0.02).tolist(), kind="int")
    for r in (1, 3, 50):
        assert (array(W.within_box(sparse, F.lit(r), ["raster_id"])) == array(W.dilate(sparse, 2 * r + 1, ["raster_id"]))).all()


def test_bridges_of_several_widths(spark):
    """Two bodies joined by a bridge of three, one of which has a neck of one: widths up to 5 cut both, a depth each."""
    a = np.zeros((13, 40), int)
    a[2:11, 1:10] = a[2:11, 12:21] = a[2:11, 24:33] = 1
    a[6, 10:12] = 1
    a[5:8, 21:24] = 1
    m = grid(spark, a.tolist(), kind="int")
    areas = lambda *args: sorted(r["count"] for r in M.split_weak_bridges(m, *args).groupBy("comp_id").count().collect())
    assert areas(3, 0.1, 1) == [81, 81 + 9 + 81]
    assert areas(5, 0.1, 1) == [81, 81 + 9 + 81]  # a split segment's parts wait for the next depth
    assert areas(5, 0.1, 2) == [81, 81, 81]


def test_wide_boxes_are_the_narrow_ones(spark, monkeypatch):
    """Blocks give what sliding gives: odd and even widths, mirrored, wider than the raster, on rasters with gaps and negative values."""
    rng = np.random.default_rng(8)
    cells = [("r", y, x, int(rng.integers(-50, 50))) for y in range(12) for x in range(17) if rng.random() < 0.7 and not (y == 3 and x < 9)] + [("s", 0, 0, 5)]
    df = spark.createDataFrame(cells, "raster_id string, y int, x int, v int")
    value = {c[:3]: c[3] for c in cells}
    for k, mirrored in ((2, False), (3, False), (4, True), (5, False), (16, False), (41, False)):
        low, high = W._reach(k, mirrored)
        monkeypatch.setattr(W, "SLIDING", 1)
        got = {(r.raster_id, r.y, r.x): r.v for r in W.dilate(df, k, ["raster_id"], mirrored=mirrored).collect()}
        # Rows first, then columns, over the cells there are.
        rows = {c: max(v for d, v in value.items() if d[:2] == c[:2] and low <= d[2] - c[2] <= high) for c in value}
        assert got == {c: max(v for d, v in rows.items() if (d[0], d[2]) == (c[0], c[2]) and low <= d[1] - c[1] <= high) for c in value}
    eroded = W.erode(df, 7, ["raster_id"]).collect()
    monkeypatch.setattr(W, "SLIDING", 99)
    assert sorted(eroded) == sorted(W.erode(df, 7, ["raster_id"]).collect())


def test_adaptive_close_stops_raster_by_raster(spark):
    """Against closing and labelling everything anew each time."""
    rng = np.random.default_rng(3)
    rasters = {"thick": (rng.random((24, 24)) < 0.75).astype(int), "thin": (rng.random((24, 24)) < 0.12).astype(int), "middle": (rng.random((24, 24)) < 0.3).astype(int), "none": np.zeros((24, 24), int)}
    df = spark.createDataFrame([(k, y, x, int(a[y, x])) for k, a in rasters.items() for y in range(24) for x in range(24)], "raster_id string, y int, x int, v int")

    def ellipse(a, k, best):
        r = k // 2
        offsets = [(dy, dx) for dy in range(-r, k - r) for dx in range(-round((r * r - dy * dy) ** 0.5), round((r * r - dy * dy) ** 0.5) + 1)]
        return np.array([[best(a[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < 24 and 0 <= x + dx < 24) for x in range(24)] for y in range(24)])

    sizes, t, least, change = (3, 5, 7), 0.2 * 576, 1, 4
    stopped, want = {}, {}
    for k, a in rasters.items():
        areas = lambda a: [len(g) for g in flood({("r", int(y), int(x)) for y, x in zip(*np.nonzero(a), strict=True)}, ALL_ROUND)]
        stopped[k], prev = 0, 0
        if not (sum(n > 1.5 * t for n in areas(a)) >= least or any(n > 2 * t for n in areas(a))):
            for size in sizes:
                a = ellipse(ellipse(a, size, max), size, min)
                stopped[k] = size
                n = len(areas(a)) + 1
                if sum(x > t for x in areas(a)) >= least or abs(prev - n) < change:
                    break
                prev = n
        want[k] = a
    assert len(set(stopped.values())) >= 3
    got = M.adaptive_close(df, 0.2, least, sizes, change)
    for k, a in want.items():
        assert (array(got.where(F.col("raster_id") == k)) == a).all(), k


#: Operators on a written mask, whose files are far smaller than its rows.
_ON_WRITTEN = {
    "region_props": lambda m, none: M.region_props(M.label_components(m, 8)),
    "filter_regions": lambda m, none: M.filter_regions(m, 0.01, 0.1),
    "split_weak_bridges": lambda m, none: M.split_weak_bridges(m, 3, 0.05, 1),
    "split_bridges_deep": lambda m, none: M.split_weak_bridges(m, 7, 0.02, 2),
    "keep_low_nodata_segments": lambda m, none: M.keep_low_nodata_segments(m, none, 1, most_width=3, least_share=0.05, depth=1),
    "adaptive_close": lambda m, none: M.adaptive_close(m, 0.3, 1, (3, 5), 1),
    "segment_candidates": lambda m, none: P.segment_candidates(
        m.withColumn("v", F.lit(255.0)), m.where("v = 1").select("raster_id", F.lit(1).alias("seg_id"), "y", "x"), m.withColumn("b", F.lit(0)), none, 24, 24, 0.01, 0.1, 0.9, 3, 2, 0.9
    ),
    "segment_green": lambda m, none: P.segment_green(m.select("raster_id", "y", "x", F.lit(10).alias("r"), (10 + 190 * F.col("v")).alias("g"), F.lit(10).alias("b")), P.GreenMask(
        close_sizes=(3, 5), border=1, bridge_width=3, bridge_depth=1, buffer=1, least_covered=0.0
    )),
}


@pytest.mark.parametrize("name", _ON_WRITTEN)
def test_cells_regions_and_segments_are_not_broadcast(spark, monkeypatch, name):
    """Only what has a row a raster may be sent to every executor, through the driver's memory."""
    m = written(grid(spark, random_mask(9, 24, 24, 0.6).tolist(), kind="int"), "mask")
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (M, R, G, P):
        monkeypatch.setattr(module, "written", seen)
    out = _ON_WRITTEN[name](m, m.select("raster_id", "y", "x", F.lit(False).alias("nodata")))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count()
    keys = {re.sub(r"#\d+", "", k) for plan in plans for k in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)}
    assert keys <= {"raster_id"} and not any("BroadcastNestedLoopJoin" in plan for plan in plans)
