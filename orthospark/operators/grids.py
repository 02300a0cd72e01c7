"""Joins between cell grids: resampling, stacking of scales, set operations on masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("raster_id").agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))


def resample_nearest(cells: DataFrame, h: int, w: int) -> DataFrame:
    """Every target cell takes the source cell that its corner falls in: a cell is sent on to those whose corner it holds, and none is looked up."""

    def held(at: str, size: str, n: int) -> Column:
        first, past = (F.ceil((F.col(at).cast("long") + k) * n / F.col(size)).cast("int") for k in (0, 1))
        return F.when(first < past, F.sequence(first, past - 1))

    sized = cells.join(_sizes(cells), "raster_id")
    return sized.withColumn("ty", F.explode(held("y", "__h", h))).withColumn("tx", F.explode(held("x", "__w", w))).select("raster_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def _linear(sizes: DataFrame, n: int, align_corners: bool) -> DataFrame:
    """``(size, at, to, weight)``: how much the cells ``at`` of a line of ``size`` count in the n cells ``to`` of the new one; of each ``to`` they sum to one.
    A border cell stands in for those outside."""
    size = F.col("size")
    s = F.col("to") * (size - 1) / max(n - 1, 1) if align_corners else (F.col("to") + 0.5) * size / n - 0.5
    at = sizes.distinct().withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("s", F.least(F.greatest(s, F.lit(0.0)), size - 1.0))
    low = F.floor("s").cast("int")
    share = F.col("s") - low
    both = F.array(F.struct(low.alias("at"), (1 - share).alias("weight")), F.struct(F.least(low + 1, size - 1).alias("at"), share.alias("weight")))
    return at.select("size", "to", F.inline(both)).where("weight > 0")


def resample_bilinear(cells: DataFrame, h: int, w: int, align_corners: bool = False) -> DataFrame:
    """Rows are resized along x, and what comes of them along y: each time a cell is sent on to the new ones it counts in, by a
    table of weights a size of raster, and no cell is looked up."""
    sized = cells.join(_sizes(cells), "raster_id")
    across = _linear(sized.select(F.col("__w").alias("size")), w, align_corners)
    rows = sized.join(across, (F.col("__w") == F.col("size")) & (F.col("x") == F.col("at")))
    rows = rows.groupBy("raster_id", "__h", "y", F.col("to").alias("x")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    down = _linear(sized.select(F.col("__h").alias("size")), h, align_corners)
    found = rows.join(down, (F.col("__h") == F.col("size")) & (F.col("y") == F.col("at")))
    return found.groupBy("raster_id", F.col("to").alias("y"), "x").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def _shares(at: str, size: str, new: str) -> Column:
    """``(to, part)`` of the one or two new cells over which a cell of a line lies; the parts of a new cell sum to the line's old size.
    In whole numbers: a cell is ``new`` long, a new cell ``size``."""
    start, end = F.col(at) * F.col(new), (F.col(at) + 1) * F.col(new)
    first, last = F.floor(start / F.col(size)).cast("int"), F.floor((end - 1) / F.col(size)).cast("int")
    return F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("to"), (F.least(end, (t + 1) * F.col(size)) - F.greatest(start, t * F.col(size))).alias("part")))


def regrid(cells: DataFrame, h: int, w: int) -> DataFrame:
    """Down to at most h by w, keeping the sides' ratio: each new cell is the mean of what lies under it, cells across its border by
    the part of them that does."""
    high, wide = F.col("__h").cast("long"), F.col("__w").cast("long")
    by_height = h * wide <= w * high
    new_h = F.when((high <= h) & (wide <= w), high).when(by_height, F.lit(h)).otherwise(F.greatest(F.lit(1), F.floor(high * w / wide)))
    new_w = F.when((high <= h) & (wide <= w), wide).when(by_height, F.greatest(F.lit(1), F.floor(wide * h / high))).otherwise(F.lit(w))
    at = cells.join(_sizes(cells), "raster_id").withColumn("__nh", new_h.cast("int")).withColumn("__nw", new_w.cast("int"))
    over = at.withColumn("__y", F.explode(_shares("y", "__h", "__nh"))).withColumn("__x", F.explode(_shares("x", "__w", "__nw")))
    weight = F.col("__y.part") * F.col("__x.part")
    whole = F.col("__h").cast("long") * F.col("__w")
    return over.groupBy("raster_id", F.col("__y.to").alias("y"), F.col("__x.to").alias("x")).agg(F.sum(F.col("v") * weight / whole).alias("v"))


def concat_features(scales: list[DataFrame], h: int, w: int) -> DataFrame:
    """Feature cells (raster_id, y, x, v) of several scales on one grid, side by side in one array."""
    out = None
    for k, scale in enumerate(scales):
        one = resample_bilinear(scale, h, w).withColumnRenamed("v", f"__v{k}")
        out = one if out is None else out.join(one, ["raster_id", "y", "x"])
    return out.select("raster_id", "y", "x", F.array(*[f"__v{k}" for k in range(len(scales))]).alias("feat"))


def mask_union(masks: list[DataFrame]) -> DataFrame:
    rows = masks[0]
    for m in masks[1:]:
        rows = rows.unionByName(m)
    return rows.groupBy("raster_id", "y", "x").agg(F.max("v").alias("v"))


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells set in both."""
    return a.where("v = 1").join(b.where("v = 1").select("raster_id", "y", "x"), ["raster_id", "y", "x"], "left_semi")


def mask_complement(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", 1 - F.col("v"))


def remove_labels(cells: DataFrame, labels: DataFrame, label: str = "comp_id") -> DataFrame:
    """Cells whose component isn't listed."""
    return cells.join(labels.select("raster_id", label).hint("merge"), ["raster_id", label], "left_anti")


def neighbour_join(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Dilation by any small set of (dy, dx) offsets."""
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    moved = cells.where("v = 1").select("raster_id", "y", "x", F.inline(shifts)).select("raster_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    return cells.drop("v").join(moved.withColumn("__hit", F.lit(1)), ["raster_id", "y", "x"], "left").withColumn("v", F.coalesce("__hit", F.lit(0))).drop("__hit")
