"""Connected regions of 0/1 masks, and the cleaning built on them.

Masks are dense: a row (raster_id, y, x, v) for every cell; regions are those of :mod:`orthospark.operators.regions`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthospark.functions.columns import hsv_between
from orthospark.operators.graph import connected
from orthospark.operators.grids import remove_labels
from orthospark.operators.regions import RASTER, label_components
from orthospark.operators.windows import chessboard_distance, close, dilate, ellipse_dilate, ellipse_erode, erode, l1_dilate, within_box
from orthospark.sources.scratch import written


def region_areas(labelled: DataFrame, keys: list[str] = RASTER) -> DataFrame:
    return labelled.groupBy(*keys, "comp_id").agg(F.count("*").alias("area"))


def region_props(labelled: DataFrame, keys: list[str] = RASTER) -> DataFrame:
    """Area, perimeter and circularity (4 pi A / P**2, 0 where P is 0) of each region.

    The perimeter adds up border cells by how their border neighbours lie: a border cell has a side
    neighbour outside the region."""
    cell = [*keys, "comp_id", "y", "x"]
    sides, corners = [(-1, 0), (1, 0), (0, -1), (0, 1)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]

    def met(rows: DataFrame, **offsets: list[tuple[int, int]]) -> DataFrame:
        """Cells of ``rows`` and how many of them lie at each list of offsets: every cell is sent to the places around it, and no place is looked up."""
        moves = [(0, 0, "own"), *[(*at, name) for name, places in offsets.items() for at in places]]
        spread = rows.select(*cell, F.inline(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(name).alias("as")) for dy, dx, name in moves])))
        moved = spread.select(*keys, "comp_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "as")
        return moved.groupBy(*cell).agg(*[F.count_if(F.col("as") == name).alias(name) for name in ("own", *offsets)]).where("own > 0")

    border = met(labelled, side=sides).where("side < 4")
    coded = met(border, side=sides, corner=corners).withColumn("code", 1 + 2 * F.col("side") + 10 * F.col("corner"))
    # What a border cell of each code adds.
    weight = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), math.sqrt(2)).when(F.col("code").isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    around = coded.groupBy(*keys, "comp_id").agg(F.sum(weight).alias("perimeter"))
    p = F.col("perimeter")
    return region_areas(labelled, keys).join(around.hint("merge"), [*keys, "comp_id"]).withColumn("circularity", F.coalesce(F.try_divide(4 * math.pi * F.col("area"), p * p), F.lit(0.0)))


def largest_component(cells: DataFrame, conn: int = 4) -> DataFrame:
    """The mask with the largest region of each raster alone; of equals the one with the lowest label."""
    labelled = written(label_components(cells, conn), "regions")
    top = region_areas(labelled).groupBy(*RASTER).agg(F.max_by("comp_id", F.struct("area", -F.col("comp_id"))).alias("comp_id"))
    return painted(cells, labelled.join(top.hint("merge"), [*RASTER, "comp_id"], "left_semi"))


def painted(cells: DataFrame, on: DataFrame) -> DataFrame:
    """The cells with v = 1 where ``on`` has a row."""
    hit = on.select(*RASTER, "y", "x").distinct().withColumn("__on", F.lit(1))
    return cells.drop("v").join(hit.hint("merge"), [*RASTER, "y", "x"], "left").withColumn("v", F.coalesce("__on", F.lit(0))).drop("__on")


def _totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*RASTER).agg(F.count("*").alias("total"))


def fill_small_holes(cells: DataFrame, share: float) -> DataFrame:
    """Background regions (4-connected) of at most ``share`` of the raster become set."""
    back = written(label_components(cells.withColumn("v", 1 - F.col("v")), 4), "holes")
    small = region_areas(back).join(_totals(cells).hint("merge"), RASTER).where(F.col("area") <= F.floor(F.col("total") * share))
    return painted(cells, cells.where("v = 1").select(*RASTER, "y", "x").unionByName(back.join(small.hint("merge"), [*RASTER, "comp_id"], "left_semi").select(*RASTER, "y", "x")))


def fill_holes(cells: DataFrame) -> DataFrame:
    """Background regions that touch no side of the raster become set."""
    back = written(label_components(cells.withColumn("v", 1 - F.col("v")), 4), "holes")
    sides = cells.groupBy(*RASTER).agg(F.min("y").alias("__t"), F.max("y").alias("__b"), F.min("x").alias("__l"), F.max("x").alias("__r"))
    reach = back.groupBy(*RASTER, "comp_id").agg(F.min("y").alias("t"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r"))
    outer = reach.join(sides.hint("merge"), RASTER).where("t = __t OR b = __b OR l = __l OR r = __r").select(*RASTER, "comp_id")
    inner = remove_labels(back, outer).select(*RASTER, "y", "x")
    return painted(cells, cells.where("v = 1").select(*RASTER, "y", "x").unionByName(inner))


def filter_regions(cells: DataFrame, least_share: float, least_circularity: float) -> DataFrame:
    """After closing with a 3 by 3 cross: regions (8-connected) of enough and at most 90 % of the area and round
    enough, and the largest."""
    closed = written(ellipse_erode(ellipse_dilate(cells, 3, RASTER), 3, RASTER), "closed")
    labelled = written(label_components(closed, 8), "regions")
    props = written(region_props(labelled), "props")  # a row a region
    props = props.join(_totals(cells).hint("merge"), RASTER).join(props.groupBy(*RASTER).agg(F.max("area").alias("__top")).hint("merge"), RASTER)
    fits = (F.col("area") >= F.floor(F.col("total") * least_share)) & (F.col("area") <= F.floor(F.col("total") * 0.9)) & (F.col("circularity") >= least_circularity)
    return painted(cells, labelled.join(props.where(fits | (F.col("area") == F.col("__top"))).hint("merge"), [*RASTER, "comp_id"], "left_semi"))


def _framed(cells: DataFrame, segments: DataFrame, reach: int, key: list[str]) -> DataFrame:
    """Each segment, rows (key, y, x), alone on its own bounding box with ``reach`` more cells of the raster around: v is 1 on it.
    Rows follow the segments' boxes, not the raster's size times their number."""
    sides = cells.groupBy(*RASTER).agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    boxes = segments.groupBy(*key).agg(F.min("y").alias("__t"), F.max("y").alias("__b"), F.min("x").alias("__l"), F.max("x").alias("__r")).join(sides.hint("merge"), RASTER)
    span = lambda a, b, most: F.sequence(F.greatest(F.col(a) - reach, F.lit(0)), F.least(F.col(b) + reach, F.col(most)))
    frame = boxes.withColumn("y", F.explode(span("__t", "__b", "__h"))).withColumn("x", F.explode(span("__l", "__r", "__w"))).select(*key, "y", "x")
    on = segments.select(*key, "y", "x").withColumn("__on", F.lit(1))
    return frame.join(on.hint("merge"), [*key, "y", "x"], "left").withColumn("v", F.coalesce("__on", F.lit(0))).drop("__on")


def _grown(cells: DataFrame, segments: DataFrame, reach: int, grow) -> DataFrame:
    """Set cells of each segment after ``grow``, which moves its border by at most ``reach`` (raster_id, comp_id, y, x)."""
    key = [*RASTER, "comp_id"]
    return grow(_framed(cells, segments, reach, key), key).where("v = 1")


def drop_nodata_segments(cells: DataFrame, nodata: DataFrame, most_share: float, border: int, least_area: int = 20_000) -> DataFrame:
    """Regions (4-connected) that are too small, or of whose box-dilated form too much has no data, go.
    nodata: (raster_id, y, x, nodata)."""
    labelled = written(label_components(cells, 4), "regions")
    grown = _grown(cells, labelled, border, lambda m, keys: dilate(m, border, keys, mirrored=True)).join(nodata.hint("merge"), [*RASTER, "y", "x"])
    share = grown.groupBy(*RASTER, "comp_id").agg(F.avg(F.col("nodata").cast("int")).alias("share"))
    keep = region_areas(labelled).join(share.hint("merge"), [*RASTER, "comp_id"]).where((F.col("area") >= least_area) & (F.col("share") <= most_share))
    return painted(cells, labelled.join(keep.hint("merge"), [*RASTER, "comp_id"], "left_semi"))


def keep_low_nodata_segments(cells: DataFrame, nodata: DataFrame, radius: int, most_cells: int = 15_000, most_share: float = 0.15, **split) -> DataFrame:
    """Parts after splitting whose cross-dilated, filled form has little without data."""
    parts = written(split_weak_bridges(cells, **split), "parts")
    grown = written(_grown(cells, parts, radius, lambda m, keys: l1_dilate(m, radius, keys)), "grown")
    key = [*RASTER, "comp_id"]
    # One cell more around each grown form: what isn't enclosed by it reaches that frame.
    boards = _framed(cells, grown, 1, key).withColumn("__r", F.to_json(F.struct(*key)))
    filled = fill_holes(written(boards.select(F.col("__r").alias("raster_id"), "y", "x", "v"), "boards")).where("v = 1").withColumnRenamed("raster_id", "__r")
    names = grown.select(*key).distinct().withColumn("__r", F.to_json(F.struct(*key)))
    counted = filled.join(names.hint("merge"), "__r").join(nodata.hint("merge"), [*RASTER, "y", "x"]).groupBy(*key).agg(F.count_if("nodata").alias("n"), F.avg(F.col("nodata").cast("int")).alias("share"))
    keep = counted.where((F.col("n") <= most_cells) & (F.col("share") <= most_share))
    return painted(cells, parts.join(keep.hint("merge"), key, "left_semi"))


def segment_spread(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """Population deviation of each band in each region; cells: (raster_id, y, x, b, v)."""
    return labelled.select(*RASTER, "y", "x", "comp_id").join(cells.hint("merge"), [*RASTER, "y", "x"]).groupBy(*RASTER, "comp_id", "b").agg(F.stddev_pop("v").alias("std"))


def zscore_outliers(stats: DataFrame, threshold: float, value: str = "std") -> DataFrame:
    """Regions whose value in any band is more than ``threshold`` deviations below the mean of all regions."""
    moments = stats.groupBy(*RASTER, "b").agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    z = F.try_divide(F.col(value) - F.col("__mean"), F.col("__std"))
    return stats.join(moments.hint("merge"), [*RASTER, "b"]).withColumn("z", z).groupBy(*RASTER, "comp_id").agg(F.coalesce(F.bool_or(F.col("z") < -threshold), F.lit(False)).alias("outlier"))


def drop_low_variance_segments(cells: DataFrame, bands: DataFrame, threshold: float = 1.5) -> DataFrame:
    labelled = written(label_components(cells, 4), "regions")
    out = zscore_outliers(segment_spread(labelled, bands), threshold).where("outlier")
    return painted(cells, remove_labels(labelled, out))


def _merged_regions(labelled: DataFrame, roots: DataFrame, areas: DataFrame, added: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions (8-connected) after cells were added to them; only the added cells are labelled.

    labelled: (raster_id, y, x, node) of the set cells so far, node being the region in which a cell first was; roots: (node, root), the region
    that it is part of by now; areas: (raster_id, root, area). New regions and those they touch merge into one node of a higher level."""
    new = label_components(added.withColumn("v", F.lit(1)), 8)
    new = written(new.select(*RASTER, "y", "x", F.struct(*RASTER, F.lit(level).alias("level"), "comp_id").alias("node")), "added")
    steps = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    near = new.select(*RASTER, F.col("node").alias("u"), F.explode(steps).alias("at")).select(*RASTER, "at.*", "u")
    touched = near.join(labelled.hint("merge"), [*RASTER, "y", "x"]).select("u", "node").distinct()
    joined = written(connected(touched.join(roots.hint("merge"), "node").select("u", F.col("root").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("top")), "joined")
    now = lambda df: df.join(joined.hint("merge"), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    own = new.groupBy(*RASTER, F.col("node").alias("root")).agg(F.count("*").alias("area"))
    roots = written(now(roots.unionByName(own.select(F.col("root").alias("node"), "root"))), "roots")
    areas = written(now(areas.unionByName(own)).groupBy(*RASTER, "root").agg(F.sum("area").alias("area")), "areas")
    return labelled.unionByName(new), roots, areas


def adaptive_close(cells: DataFrame, threshold: float, least: int, sizes: tuple[int, ...] = (3, 9, 15, 21, 27), least_change: int = 100) -> DataFrame:
    """Ellipse closings of growing size, one after the other, of each raster until it has enough large regions or
    the number of regions changes by less than ``least_change``. Rasters that have them from the start stay as they are.

    A closing only adds cells, so regions only merge: each round labels the cells that it added and merges what they touch,
    and areas are added up along that tree of regions. Rasters leave when they stop."""
    key = [*RASTER, "y", "x"]

    def facts(areas: DataFrame) -> DataFrame:
        sized = areas.join(_totals(cells).hint("merge"), RASTER)
        a, t = F.col("area"), threshold * F.col("total")
        return sized.groupBy(*RASTER).agg(F.count("*").alias("n"), F.count_if(a > t).alias("large"), F.count_if(a > 1.5 * t).alias("larger"), F.count_if(a > 2 * t).alias("largest"))

    labelled = written(label_components(cells, 8).select(*key, F.struct(*RASTER, F.lit(0).alias("level"), "comp_id").alias("node")), "regions")
    areas = labelled.groupBy(*RASTER, F.col("node").alias("root")).agg(F.count("*").alias("area"))
    roots = written(areas.select(F.col("root").alias("node"), "root"), "roots")
    start = written(facts(areas).where((F.col("larger") >= least) | (F.col("largest") >= 1)).select(*RASTER), "settled")
    of_open = lambda df: df.join(start, RASTER, "left_anti")
    done = written(cells.join(start, RASTER, "left_semi"), "masks")
    open_, labelled, areas = written(of_open(cells), "masks"), of_open(labelled), written(of_open(areas), "areas")
    before = open_.select(*RASTER).distinct().withColumn("prev", F.lit(0).cast("long"))
    for level, size in enumerate(sizes, 1):
        closed = written(ellipse_erode(ellipse_dilate(open_, size, RASTER), size, RASTER), "masks")
        added = closed.where("v = 1").join(open_.where("v = 1").select(*key).hint("merge"), key, "left_anti").select(*key)
        labelled, roots, areas = _merged_regions(labelled, roots, areas, added, level)
        # Without regions a raster has only its background, one label.
        now = written(before.join(facts(areas), RASTER, "left").select(*RASTER, "prev", (F.coalesce("n", F.lit(0)) + 1).alias("n"), F.coalesce("large", F.lit(0)).alias("large")), "counts")
        stop = now.where((F.col("large") >= least) | (F.abs(F.col("prev") - F.col("n")) < least_change)).select(*RASTER)
        done = done.unionByName(closed.join(stop, RASTER, "left_semi"))
        open_ = written(closed.join(stop, RASTER, "left_anti"), "masks")
        if level == len(sizes) or open_.isEmpty():
            break
        before = now.join(stop, RASTER, "left_anti").select(*RASTER, F.col("n").alias("prev"))
        labelled, areas = (df.join(stop, RASTER, "left_anti") for df in (labelled, areas))
    return done.unionByName(open_)


def _bands(most: int) -> list[list[int]]:
    """Radii 1 to ``most``, in bands twice as long each."""
    return [list(range(1 << i, min(1 << (i + 1), most + 1))) for i in range(most.bit_length())]


def _cut_cores(levels: DataFrame, key: list[str], least_share: float) -> DataFrame:
    """Parts (key, radius, comp_id, y, x) of the segments that fall into several large ones, at the least radius ``r`` at which they do; levels: (key, r, y, x)."""
    by = [*key, "r"]
    core = written(label_components(levels.withColumn("v", F.lit(1)), 8, by), "cores")
    sizes = core.groupBy(*by, "comp_id").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(*by).agg(F.sum("n").alias("all"))
    large = sizes.join(whole.hint("merge"), by).where(F.col("n") >= F.floor(F.col("all") * least_share)).select(*by, "comp_id")
    least = large.groupBy(*by).agg(F.count("*").alias("parts")).where("parts > 1").groupBy(*key).agg(F.min("r").alias("r"))
    return core.join(large.join(least.hint("merge"), by).hint("merge"), [*by, "comp_id"], "left_semi").drop("v")


def split_weak_bridges(cells: DataFrame, most_width: int, least_share: float, depth: int) -> DataFrame:
    """Parts (raster_id, y, x, comp_id) of 8-connected regions after cutting narrow bridges.

    At each depth the distance of all open segments' cells to what is around them is worked out once; the erosion by a box of width k is
    a level of it. Levels are looked at in bands of widths, twice as many each time; a segment that falls into several large
    parts is replaced by them, dilated back within it by the same box, and goes one deeper. The others go on to the next band."""
    found = written(label_components(cells, 8).select(*RASTER, "y", "x", F.col("comp_id").cast("string").alias("seg")), "segments")
    key = [*RASTER, "seg"]
    most, settled = (most_width - 1) // 2, None
    for _ in range(depth):
        split = None
        distances = written(chessboard_distance(_framed(cells, found, 1, key), most, key).where("distance > 1"), "distances")
        for radii in _bands(most):
            levels = distances.join(found.select(*key).distinct().hint("merge"), key, "left_semi").withColumn("r", F.explode(F.sequence(F.lit(radii[0]), F.lit(radii[-1])))).where("r < distance").drop("distance")
            parts = written(_cut_cores(levels, key, least_share), "parts")
            if parts.isEmpty():
                continue
            part = [*key, "new", "r"]
            named = parts.withColumn("new", F.concat_ws("/", "seg", "r", "comp_id"))
            back = within_box(_framed(cells, named, radii[-1], part), F.col("r"), part).where("v = 1").join(found.hint("merge"), [*key, "y", "x"], "left_semi")
            back = written(back.select(*RASTER, "y", "x", F.col("new").alias("seg")), "split")
            split = back if split is None else split.unionByName(back)
            found = written(found.join(parts.select(*key).distinct().hint("merge"), key, "left_anti"), "segments")
        settled = found if settled is None else settled.unionByName(found)
        if split is None:
            break
        found = split
    else:
        settled = found if settled is None else settled.unionByName(found)
    return settled.withColumn("comp_id", F.xxhash64("seg")).drop("seg")


def candidate_segments(segments: DataFrame, image: DataFrame, least_share: float, least_value: float) -> DataFrame:
    """Candidate segments (raster_id, seg_id, y, x) that are large and bright enough, eroded by 3 by 3, as one mask.
    image: (raster_id, y, x, v), dense."""
    totals = image.groupBy(*RASTER).agg(F.count("*").alias("total"))
    facts = segments.join(image.hint("merge"), [*RASTER, "y", "x"]).groupBy(*RASTER, "seg_id").agg(F.count("*").alias("area"), F.avg("v").alias("mean")).join(totals.hint("merge"), RASTER)
    share = F.col("area") / F.col("total")
    keep = facts.where(((share >= least_share) | (F.col("area") >= 12_000)) & ((F.col("mean") / 255 >= least_value) | (share >= 0.3)))
    kept = segments.join(keep.hint("merge"), [*RASTER, "seg_id"], "left_semi").select(*RASTER, F.col("seg_id").alias("comp_id"), "y", "x")
    return painted(image.drop("v"), _grown(image, kept, 1, lambda m, keys: erode(m, 3, keys)))


def accept_raster(cells: DataFrame, least_share: float = 0.08) -> DataFrame:
    """Rasters and whether enough of them is covered; the others go through the same again with a larger kernel."""
    return cells.groupBy(*RASTER).agg(F.avg("v").alias("covered")).withColumn("accepted", F.col("covered") > least_share)


def buffer_mask(cells: DataFrame, radius: int) -> DataFrame:
    return dilate(cells, 2 * radius + 1, RASTER)


def green_mask(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Cells (raster_id, y, x, r, g, b) as a mask of those within the HSV range."""
    return cells.select(*RASTER, "y", "x", F.when(hsv_between(F.col("r"), F.col("g"), F.col("b"), low, high), 1).otherwise(0).alias("v"))


def close_box(cells: DataFrame, k: int) -> DataFrame:
    return close(cells, k, RASTER)
