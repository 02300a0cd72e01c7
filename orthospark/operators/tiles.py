"""Between cell and tile tables, and tiles cut out of rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthospark.schema import CASES, REF_NODATA

TILE = ("orchard", "i", "j")
#: Size of a quantile sketch, and how far its ranks are off at most, as a share of the values (99 % of the time).
SKETCH_K, RANK_ERROR = 2048, 0.0025


def tiles_to_cells(tiles: DataFrame, *keys: str) -> DataFrame:
    """A row a tile, pixel and band: keys, y, x, b, v."""
    pixel = F.col("pos").cast("int")
    flat = tiles.select(*keys, "width", "channels", F.posexplode("data").alias("pos", "v"))
    return flat.select(*keys, F.floor(pixel / (F.col("width") * F.col("channels"))).cast("int").alias("y"), F.floor(pixel / F.col("channels") % F.col("width")).cast("int").alias("x"), (pixel % F.col("channels")).alias("b"), "v")


def cells_to_tiles(cells: DataFrame, *keys: str) -> DataFrame:
    """Rows of cells stacked into one interleaved row-major array a tile; a tile is bounded by its size."""
    stacked = cells.groupBy(*keys).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("b") + 1).alias("channels"), F.array_sort(F.collect_list(F.struct("y", "x", "b", "v"))).alias("cells")
    )
    return stacked.withColumn("data", F.transform("cells", lambda c: c["v"])).drop("cells")


def clip_bounds(cells: DataFrame, rasters: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Cells whose corner lies within world bounds; the transforms are one row a raster."""
    at = cells.join(rasters.select("raster_id", "px", "py", F.col("left").alias("__left"), F.col("top").alias("__top")), "raster_id")
    wx, wy = F.col("__left") + F.col("x") * F.col("px"), F.col("__top") + F.col("y") * F.col("py")
    return at.where(wx.between(left, right) & wy.between(bottom, top)).select(*cells.columns)


def colocate(cells: DataFrame, mask: DataFrame, ref: DataFrame) -> DataFrame:
    """Data, mask and reference of the same cell. Layers are merged at every size: their files are far smaller than their rows, so Spark takes them for small."""
    return cells.join(mask.hint("merge"), ["raster_id", "y", "x"]).join(ref.hint("merge"), ["raster_id", "y", "x"])


def assign_tiles(cells: DataFrame, height: int, width: int, block: int, overlap: int) -> DataFrame:
    """A row for each tile (i, j) a cell lies in. Only full tiles exist; cells past the last belong to none."""
    step = block - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the block")

    def within(at: Column, size: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((at - block + 1) / F.lit(step))).cast("int")
        last = F.least(F.lit((size - block) // step), F.floor(at / F.lit(step))).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    rows = cells.withColumn("i", F.explode(within(F.col("y"), height)))
    return rows.withColumn("j", F.explode(within(F.col("x"), width)))


def valid_tiles(tile_cells: DataFrame, *keys: str) -> DataFrame:
    """Keys of the tiles without an excluded mask cell or a no-data reference cell."""
    bad = F.bool_or((F.col("mask") == 0) | (F.col("ref") == REF_NODATA))
    return tile_cells.groupBy(*keys).agg(bad.alias("__bad")).where(~F.coalesce("__bad", F.lit(False))).select(*keys)


def classify_tiles(tile_cells: DataFrame, threshold: float, cells_a_tile: int, *keys: str, strict: bool = False) -> DataFrame:
    """The case of each tile: the first with enough cells, normal with none, and no row in between.

    As in common use, cells of case 3 don't keep a tile from being normal; ``strict`` counts them."""
    counts = tile_cells.groupBy(*keys).agg(*[F.count_if(F.col("mask") == k).alias(f"n{k}") for k in (1, 2, 3)])
    case = F.lit(None).cast("string")
    for k in (3, 2, 1):
        case = F.when(F.col(f"n{k}") >= threshold * cells_a_tile, CASES[k - 1]).otherwise(case)
    none = (F.col("n1") + F.col("n2") + (F.col("n3") if strict else F.lit(0))) == 0
    return counts.withColumn("case", F.coalesce(case, F.when(none, "normal"))).where(F.col("case").isNotNull())


def stack_layers(layers: list[DataFrame], *keys: str) -> DataFrame:
    """Band arrays of the same tile one after the other, in the order of the layers."""
    rows = layers[0].select(*keys, F.lit(0).alias("__layer"), "data")
    for k, layer in enumerate(layers[1:], 1):
        rows = rows.unionByName(layer.select(*keys, F.lit(k).alias("__layer"), "data"))
    stacked = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__layer", "data"))).alias("__layers"))
    return stacked.select(*keys, F.flatten(F.transform("__layers", lambda s: s["data"])).alias("data"))


def tile_percentiles(cells: DataFrame, *keys: str) -> DataFrame:
    """First and 99th percentile of each tile and band, interpolated."""
    return cells.groupBy(*keys, "b").agg(F.percentile("v", F.lit(0.01)).alias("p1"), F.percentile("v", F.lit(0.99)).alias("p99"))


def site_range(percentiles: DataFrame, site: str = "orchard") -> DataFrame:
    return percentiles.groupBy(site, "b").agg(F.min("p1").alias("lo"), F.max("p99").alias("hi"))


def site_sketches(cells: DataFrame, site: str = "orchard", k: int = SKETCH_K) -> DataFrame:
    """A KLL sketch of all values of each site and band, a few kB each, instead of the exact percentiles of each tile. Sketches of different
    tiles, days or runs merge (:func:`merged_sketches`) into that of all of them."""
    return cells.groupBy(site, "b").agg(F.kll_sketch_agg_double(F.col("v").cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, site: str = "orchard", k: int = SKETCH_K) -> DataFrame:
    return sketches.groupBy(site, "b").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_range(sketches: DataFrame, site: str = "orchard", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """lo and hi of each site and band: values whose rank is within ``RANK_ERROR`` of the ranks asked for, with a probability of 99 %."""
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
    return sketches.select(site, "b", at(low).alias("lo"), at(high).alias("hi"))


def channel_stats(cells: DataFrame, site: str = "orchard") -> DataFrame:
    return cells.groupBy(site, "b").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def map_scores(cells: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Mean and population deviation of each map, a row a metric."""
    scores = cells.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return scores.unpivot(list(keys), ["mean", "std"], "metric", "score")


def pooled_max(cells: DataFrame, window: int, *keys: str, value: str = "v") -> DataFrame:
    """Largest average over full windows of a map; null where no window fits."""
    from orthospark.operators.windows import box_mean

    return box_mean(cells, window, window, list(keys), value).groupBy(*keys).agg(F.max("pooled").alias("score"))
