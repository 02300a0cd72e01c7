"""Whole jobs: orchard masks from images or candidate segments, training tables from layers, verdicts from scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthospark.functions.columns import encode_mask, is_nodata, minmax
from orthospark.operators import evaluate, grids, masks, metadata, tiles, windows
from orthospark.sources.scratch import written


@dataclass
class GreenMask:
    """Parameters of :func:`segment_green`. The usual configuration of such jobs. ``nodata`` holds a value for each of
    the first bands of r, g, b and a fourth, where the image has one."""

    low: tuple[int, int, int] = (30, 40, 40)
    high: tuple[int, int, int] = (80, 255, 200)
    kernel: int = 3
    hole_share: float = 0.0003
    close_threshold: float = 0.03
    close_least: int = 3
    close_sizes: tuple[int, ...] = (3, 9, 15, 21, 27)
    least_share: float = 0.014
    least_circularity: float = 0.01
    nodata: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    border: int = 100
    most_nodata_cells: int = 15_000
    most_nodata_share: float = 0.15
    bridge_width: int = 100
    bridge_share: float = 0.002
    bridge_depth: int = 3
    buffer: int = 10
    least_covered: float = 0.08
    kernel_step: int = 6


def _green(image: DataFrame, p: GreenMask, kernel: int) -> DataFrame:
    key = ["raster_id"]
    mask = masks.green_mask(image, p.low, p.high)
    mask = written(windows.open_(windows.close(mask, kernel, key), kernel, key), "green")
    mask = written(masks.fill_small_holes(mask, p.hole_share), "green")
    mask = masks.adaptive_close(mask, p.close_threshold, p.close_least, p.close_sizes)
    mask = written(masks.fill_small_holes(written(mask, "green"), p.hole_share), "green")
    mask = written(masks.filter_regions(mask, p.least_share, p.least_circularity), "green")
    bands = [c for c in ("r", "g", "b", "a") if c in image.columns]
    without = image.select("raster_id", "y", "x", is_nodata(F.array(*[F.col(c).cast("double") for c in bands]), list(p.nodata[: len(bands)])).alias("nodata"))
    mask = written(masks.keep_low_nodata_segments(mask, without, p.border, p.most_nodata_cells, p.most_nodata_share, most_width=p.bridge_width, least_share=p.bridge_share, depth=p.bridge_depth), "green")
    mask = written(masks.filter_regions(mask, p.least_share, p.least_circularity), "green")
    return written(masks.fill_holes(written(masks.buffer_mask(mask, p.buffer), "green")), "green")


def segment_green(image: DataFrame, p: GreenMask | None = None) -> DataFrame:
    """Masks of green regions of images (raster_id, y, x, r, g, b): -999 inside, 0 elsewhere.

    Rasters that are hardly covered go through once more with a larger kernel."""
    p = p or GreenMask()
    mask = _green(image, p, p.kernel)
    poor = written(masks.accept_raster(mask, p.least_covered).where(~F.col("accepted")).select("raster_id"), "poor")
    if not poor.isEmpty():
        again = _green(image.join(poor, "raster_id", "left_semi"), p, p.kernel + p.kernel_step)
        mask = mask.join(poor, "raster_id", "left_anti").unionByName(again)
    return mask.withColumn("v", encode_mask(F.col("v") == 1))


def segment_candidates(image: DataFrame, segments: DataFrame, bands: DataFrame, nodata: DataFrame, h: int, w: int, least_share: float, least_value: float, most_nodata: float, border: int, least_area: int = 20_000, outlier: float = 1.5) -> DataFrame:
    """The orchard's mask from candidate segments of a small image: 0 in the largest region outside the cleaned
    segments, -999 elsewhere. bands and nodata are tables of the full h by w raster."""
    mask = grids.resample_nearest(masks.candidate_segments(segments, image, least_share, least_value), h, w)
    mask = written(masks.drop_nodata_segments(written(mask, "mask"), nodata, most_nodata, border, least_area), "mask")
    mask = written(masks.drop_low_variance_segments(mask, bands, outlier), "mask")
    return masks.largest_component(written(grids.mask_complement(mask), "mask")).withColumn("v", encode_mask(F.col("v") != 1))


def training_tiles(cells: DataFrame, mask: DataFrame, ref: DataFrame, height: int, width: int, block: int, overlap: int, threshold: float, seed: str, fit_on: str = "all") -> tuple[DataFrame, DataFrame]:
    """Labelled tiles with a split, and their scaled cells, of rasters (orchard in raster_id).

    Tiles are judged on the mask first, so only the cells of tiles that stay are spread over tiles. The scale is
    fitted on all tiles of a site, or with ``fit_on`` train on its training tiles."""
    layers = mask.join(ref, ["raster_id", "y", "x"])
    placed = tiles.assign_tiles(layers, height, width, block, overlap)
    valid = placed.join(tiles.valid_tiles(placed, "raster_id", "i", "j"), ["raster_id", "i", "j"], "left_semi")
    cases = tiles.classify_tiles(valid, threshold, block * block, "raster_id", "i", "j").select(F.col("raster_id").alias("orchard"), "i", "j", "case")
    keyed = cases.withColumn("tile_id", F.concat_ws("_", "orchard", F.lit("block"), "i", "j"))
    split = written(metadata.train_test_split(keyed, "tile_id", seed), "tiles")
    spread = tiles.assign_tiles(cells.withColumnRenamed("raster_id", "orchard"), height, width, block, overlap).join(split, ["orchard", "i", "j"])
    fitted = spread.where("split = 'train'") if fit_on == "train" else spread
    limits = tiles.site_range(tiles.tile_percentiles(fitted, "orchard", "tile_id"))
    scaled = spread.join(limits, ["orchard", "b"]).withColumn("v", minmax(F.col("v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return split, scaled


def site_inference(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Verdicts of sites from tile scores (clsname, score)."""
    return evaluate.classify_site(evaluate.class_rollup(evaluate.apply_thresholds(scores, thresholds)))
