"""Scalar expressions on pixels, bands, scores and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthospark.schema import CASES, INSIDE, OUTSIDE


def unique_id(path: Column) -> Column:
    """A path as an identifier: separators and dots become underscores."""
    return F.regexp_replace(path, r"[/\\.]", "_")


def path_class(path: Column, given: Column | None = None) -> Column:
    """The given class, else the fourth part of the path from its end."""
    part = F.try_element_at(F.split(path, r"[/\\]"), F.lit(-4))
    return part if given is None else F.coalesce(given, part)


def result_key(clsname: Column, path: Column) -> Column:
    """class, parent directory and file stem, joined by underscores."""
    parts = F.split(path, r"[/\\]")
    return F.concat_ws("_", clsname, F.try_element_at(parts, F.lit(-2)), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))


def pixel_to_world(x: Column, y: Column, left: Column, top: Column, px: Column, py: Column) -> tuple[Column, Column]:
    return left + x * px, top + y * py


def world_to_pixel(wx: Column, wy: Column, left: Column, top: Column, px: Column, py: Column) -> tuple[Column, Column]:
    return F.floor(F.try_divide(wx - left, px)), F.floor(F.try_divide(wy - top, py))


def scale_transform(px: Column, py: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> tuple[Column, Column]:
    """Pixel sizes after a resize."""
    return px * F.try_divide(w, new_w), py * F.try_divide(h, new_h)


def patch_pixels(size: Column, pixel: Column) -> Column:
    """Pixels in a patch given in micro-degrees; truncated twice, as the sizes are whole numbers of micro-degrees."""
    return (F.try_divide(size, F.abs(pixel)).cast("long") * F.lit(1e-6)).cast("int")


def scaled_size(ratio: Column, w: Column, h: Column, other_w: Column, other_h: Column) -> tuple[Column, Column]:
    """Size of the preferred layer, else of the other, times the ratio, truncated."""
    return (ratio * F.coalesce(w, other_w)).cast("int"), (ratio * F.coalesce(h, other_h)).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """8-bit HSV of 8-bit RGB: hue halved to 0..179, saturation and value 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(top == r, 60 * F.try_divide(g - b, span)).when(top == g, 120 + 60 * F.try_divide(b - r, span)).otherwise(240 + 60 * F.try_divide(r - g, span))
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.when(sector < 0, sector + 360).otherwise(sector))
    half = F.round(hue / 2).cast("int")
    return F.struct(F.when(half >= 180, half - 180).otherwise(half).alias("h"), F.round(F.coalesce(F.try_divide(255 * span, top), F.lit(0.0))).cast("int").alias("s"), top.cast("int").alias("v"))


def hsv_between(r: Column, g: Column, b: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    c = hsv(r, g, b)
    return c["h"].between(low[0], high[0]) & c["s"].between(low[1], high[1]) & c["v"].between(low[2], high[2])


def is_nodata(bands: Column, value: list[float]) -> Column:
    """Every band holds the no-data value."""
    return bands == F.array(*[F.lit(float(v)) for v in value])


def label(case: Column) -> Column:
    """0 for normal tiles, 1 for the anomaly cases; null for other names."""
    return F.when(case == "normal", 0).when(case.isin(*CASES), 1)


def label_name(case: Column) -> Column:
    return F.when(case == "normal", "good").when(case.isin(*CASES), "defective")


def one_class_label(cls: Column, normals: list[int]) -> Column:
    return F.when(cls.isin(*normals), 0).otherwise(1)


def constant_mask(label_: Column, height: Column, width: Column, on: int = 255) -> Column:
    """A mask of zeros for label 0 and of ``on`` for label 1; other labels are an error."""
    value = F.when(label_ == 0, 0).when(label_ == 1, on).otherwise(F.raise_error(F.lit("a label is neither 0 nor 1")).cast("int"))
    return F.array_repeat(value, (height * width).cast("int"))


def normalize_bands(data: Column, mean: list[float], std: list[float], channels: Column) -> Column:
    """(v - mean) / std by channel of an interleaved array."""
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    return F.transform(data, lambda v, k: F.try_divide(v - F.element_at(m, (k % channels + 1).cast("int")), F.element_at(s, (k % channels + 1).cast("int"))))


def denormalize_bands(data: Column, mean: list[float], std: list[float], channels: Column) -> Column:
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    return F.transform(data, lambda v, k: (v * F.element_at(s, (k % channels + 1).cast("int")) + F.element_at(m, (k % channels + 1).cast("int"))) * 255)


def three_channels(bands: Column) -> Column:
    """One band thrice, two as a, b, a, and of more the first three."""
    a, b = F.element_at(bands, 1), F.try_element_at(bands, F.lit(2))
    return F.when(F.size(bands) == 1, F.array(a, a, a)).when(F.size(bands) == 2, F.array(a, b, a)).otherwise(F.slice(bands, 1, 3))


def minmax(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo) within 0 and 1; null where the range is empty."""
    scaled = F.try_divide(v - lo, hi - lo)
    return F.when(scaled.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def verdict(score: Column, lower: Column, upper: Column) -> Column:
    """below, above or Normal; the limits themselves are Normal."""
    return F.when(score < lower, "below").when(score > upper, "above").when(score.isNotNull(), "Normal")


def encode_mask(flag: Column, flagged: int = OUTSIDE) -> Column:
    return F.when(flag, flagged).otherwise(INSIDE if flagged == OUTSIDE else OUTSIDE)


def blend(image: Column, score: Column, alpha: float = 0.5) -> Column:
    return alpha * image + (1 - alpha) * score


def percent(part: Column, total: Column) -> Column:
    return F.format_string("%.2f%%", F.coalesce(F.try_divide(part * F.lit(100.0), total), F.lit(0.0)))


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def anomaly_distance(feature: Column, rebuilt: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(feature, rebuilt, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def mean_square(a: Column, b: Column) -> Column:
    return F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), F.size(a))


def jitter(feature: Column, key: Column, scale: float, probability: float, seed: int) -> Column:
    """With a probability, noise of the size of the vector's mean component, drawn from the key and the seed
    (so the same rows get the same noise wherever they are)."""
    unit = lambda *salt: (F.pmod(F.xxhash64(key, F.lit(seed), *salt), F.lit(1 << 30)) + 0.5) / (1 << 30)
    norm = F.sqrt(F.aggregate(feature, F.lit(0.0), lambda s, v: s + v * v)) / F.size(feature) * scale
    noise = lambda k: F.sqrt(-2 * F.log(unit(k, F.lit("r")))) * F.cos(2 * math.pi * unit(k, F.lit("a")))
    return F.when(unit(F.lit("p")) < probability, F.transform(feature, lambda v, k: v + noise(k) * norm)).otherwise(feature)


def turned(data: Column, height: int, width: int, channels: int, turn: str) -> Column:
    """An interleaved tile flipped (h, v) or rotated by 90, 180 or 270 degrees counter-clockwise."""
    rows = width if turn in ("90", "270") else height
    cols = height if turn in ("90", "270") else width
    p = lambda k: F.floor(k / channels)
    y, x = (lambda k: F.floor(p(k) / cols)), (lambda k: p(k) % cols)
    source = {
        "h": lambda k: y(k) * width + (width - 1 - x(k)),
        "v": lambda k: (height - 1 - y(k)) * width + x(k),
        "90": lambda k: x(k) * width + (width - 1 - y(k)),
        "180": lambda k: (height - 1 - y(k)) * width + (width - 1 - x(k)),
        "270": lambda k: (height - 1 - x(k)) * width + y(k),
    }[turn]
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols * channels - 1)), lambda k: F.element_at(data, (source(k) * channels + k % channels + 1).cast("int")))


def drawn_turns(key: Column, seed: str) -> Column:
    """Flips (h, v) and quarter turns (0 to 3) drawn from a key and a seed, to be applied to a tile and its mask alike."""
    digit = lambda what: F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}|{what}"))), 1, 1), 16, 10).cast("int")
    return F.struct((digit("h") < 8).alias("h"), (digit("v") < 8).alias("v"), (digit("t") % 4).alias("turn"))


def turned_as_drawn(data: Column, size: int, channels: int, draw: Column) -> Column:
    """A square interleaved tile after the flips and the turn of :func:`drawn_turns`, in one pass: each place takes the one that it comes from."""
    end, turn = size - 1, draw["turn"]

    def source(y: int, x: int) -> Column:
        row = F.when(turn == 1, x).when(turn == 2, end - y).when(turn == 3, end - x).otherwise(y)
        col = F.when(turn == 1, end - y).when(turn == 2, end - x).when(turn == 3, y).otherwise(x)
        return F.when(draw["v"], end - row).otherwise(row) * size + F.when(draw["h"], end - col).otherwise(col)

    # A place's source is linear in its row and column. An array of one binds tile and draw, which are then worked out once a tile, not once a place.
    start = source(0, 0)
    bound = F.array(F.struct(data.alias("data"), start.alias("start"), (source(1, 0) - start).alias("down"), (source(0, 1) - start).alias("along")))
    at = lambda b, k: b["start"] + b["down"] * F.floor(k / (size * channels)) + b["along"] * (F.floor(k / channels) % size)
    moved = lambda b: F.transform(F.sequence(F.lit(0), F.lit(size * size * channels - 1)), lambda k: F.element_at(b["data"], (at(b, k) * channels + k % channels + 1).cast("int")))
    return F.element_at(F.transform(bound, moved), 1)
