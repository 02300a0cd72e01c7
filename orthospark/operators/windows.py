"""Window operators: neighbourhoods of cells, and running values over ordered series.

Windows over cells are cut by row or column of a raster, never by raster alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The widest box that slides over a line cell by cell; up to about there it is the faster way.
SLIDING = 99
#: Farther than any two cells of a line.
FAR = 1 << 30


def _reach(k: int, mirrored: bool = False) -> tuple[int, int]:
    """Offsets that a kernel of width k covers, around its anchor k // 2, or the other way round."""
    before, after = k // 2, k - 1 - k // 2
    return (-after, before) if mirrored else (-before, after)


def _row(keys: list[str], k: int, mirrored: bool = False):
    return Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(*_reach(k, mirrored))


def _column(keys: list[str], k: int, mirrored: bool = False):
    return Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(*_reach(k, mirrored))


def _extreme(cells: DataFrame, value: str, to: str, k: int, keys: list[str], along: str, best, reach: tuple[int, int]) -> DataFrame:
    """Adds ``to``: the ``best`` value over ``k`` places of the line, from reach[0] to reach[1] around each cell.

    Narrow boxes slide. Those wider than ``SLIDING`` cost the same at any width: lines are cut in blocks of k places, so a box
    ends in at most two of them; best values run through each block from either end, and a box takes the one from its first cell to
    the end of that cell's block, and the one from the start of its last cell's block to that cell."""
    across = "y" if along == "x" else "x"
    line = Window.partitionBy(*keys, across)
    if k <= SLIDING:
        return cells.withColumn(to, best(value).over(line.orderBy(along).rangeBetween(*reach)))
    low, high = reach
    block = Window.partitionBy(*keys, across, "__block")
    running = lambda order: best(value).over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    dealt = cells.repartition(*keys, across).withColumn("__block", F.floor(F.col(along) / k))
    ends = dealt.withColumn("__head", running(F.asc(along))).withColumn("__tail", running(F.desc(along)))
    # The last cell there is in the box, and the first one; a block without a cell of the box gives nothing.
    last = F.last(F.struct("__block", "__head")).over(line.orderBy(along).rangeBetween(Window.unboundedPreceding, high))
    first = F.last(F.struct("__block", "__tail")).over(line.orderBy(F.desc(along)).rangeBetween(Window.unboundedPreceding, -low))
    met = ends.withColumn("__last", last).withColumn("__first", first)
    within = lambda side, what, at: F.when(F.col(side)["__block"] == F.floor((F.col(along) + at) / k), F.col(side)[what])
    pick = F.greatest if best is F.max else F.least
    return met.withColumn(to, pick(within("__last", "__head", high), within("__first", "__tail", low))).drop("__block", "__head", "__tail", "__last", "__first")


def _box(cells: DataFrame, k: int, keys: list[str], value: str, best, mirrored: bool = False) -> DataFrame:
    reach = _reach(k, mirrored)
    return _extreme(_extreme(cells, value, "__row", k, keys, "x", best, reach), "__row", value, k, keys, "y", best, reach).drop("__row")


def dilate(cells: DataFrame, k: int, keys: list[str], value: str = "v", mirrored: bool = False) -> DataFrame:
    """Largest value over a k by k box of the cells there are; rows first, then columns. ``mirrored`` matters for even k only."""
    return _box(cells, k, keys, value, F.max, mirrored)


def erode(cells: DataFrame, k: int, keys: list[str], value: str = "v") -> DataFrame:
    return _box(cells, k, keys, value, F.min)


def close(cells: DataFrame, k: int, keys: list[str], value: str = "v") -> DataFrame:
    return erode(dilate(cells, k, keys, value), k, keys, value)


def open_(cells: DataFrame, k: int, keys: list[str], value: str = "v") -> DataFrame:
    return dilate(erode(cells, k, keys, value), k, keys, value)


def box_mean(cells: DataFrame, kh: int, kw: int, keys: list[str], value: str = "v", full_only: bool = True) -> DataFrame:
    """keys, y, x and pooled: the mean over a kh by kw box; of full boxes only, or null elsewhere."""
    row, column = _row(keys, kw), _column(keys, kh)
    once = cells.withColumn("__s", F.sum(value).over(row)).withColumn("__n", F.count(value).over(row))
    both = once.withColumn("__t", F.sum("__s").over(column)).withColumn("__m", F.sum("__n").over(column))
    pooled = both.select(*keys, "y", "x", F.when(F.col("__m") == kh * kw, F.col("__t") / (kh * kw)).alias("pooled"))
    return pooled.where(F.col("pooled").isNotNull()) if full_only else pooled


def l1_dilate(cells: DataFrame, radius: int, keys: list[str], value: str = "v") -> DataFrame:
    """Dilation of a 0/1 mask by ``radius`` steps of a cross: cells within that city-block distance of a set one.

    Exact distance in two passes: the nearest set cell of the row on either side, then, down the
    columns, the least of distance less y and of distance plus y."""
    along = Window.partitionBy(*keys, "y").orderBy("x")
    before, after = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value) == 1, F.col("x"))
    far = F.lit(1 << 30)
    row = cells.withColumn("__d", F.least(F.coalesce(F.col("x") - F.last(at, True).over(before), far), F.coalesce(F.first(at, True).over(after) - F.col("x"), far)))
    down = Window.partitionBy(*keys, "x").orderBy("y")
    above, below = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(0, Window.unboundedFollowing)
    d = F.least(F.min(F.col("__d") - F.col("y")).over(above) + F.col("y"), F.min(F.col("__d") + F.col("y")).over(below) - F.col("y"))
    return row.withColumn(value, F.when(d <= radius, 1).otherwise(0)).drop("__d")


def _nearest(at: Column, keys: list[str], along: str) -> tuple[Column, Column]:
    """The last ``at`` that isn't null before a cell or on it, and the next one, running along rows or columns from either end."""
    line = Window.partitionBy(*keys, "y" if along == "x" else "x")
    return tuple(F.last(at, True).over(line.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for order in (F.asc(along), F.desc(along)))


def _gap(at: Column, keys: list[str], along: str) -> Column:
    """How far the nearest ``at`` that isn't null is along the line; far where there is none."""
    before, after = _nearest(at, keys, along)
    return F.least(F.coalesce(F.col(along) - before, F.lit(FAR)), F.coalesce(after - F.col(along), F.lit(FAR)))


def chessboard_distance(cells: DataFrame, most: int, keys: list[str], value: str = "v") -> DataFrame:
    """keys, y, x, distance of the set cells of a 0/1 mask: to the nearest cell there is that isn't set, in steps of a king, at most ``most`` + 1.

    Two separable passes: along rows, how far the nearest such cell is; down columns, for each r how far the
    nearest row is in which it is at most r away. A cell outlives the erosion by a box of 2 r + 1 if that is more than r, so the box's erosions are
    the levels of the distance, and none of them costs a pass of its own."""
    row = cells.withColumn("__g", _gap(F.when(F.col(value) == 0, F.col("x")), keys, "x"))
    away = {r: _gap(F.when(F.col("__g") <= r, F.col("y")), keys, "y") for r in range(1, most + 1)}
    levels = row.select(*keys, "y", "x", value, *[(d > r).cast("int").alias(f"__{r}") for r, d in away.items()])
    return levels.where(F.col(value) == 1).select(*keys, "y", "x", sum((F.col(f"__{r}") for r in away), F.lit(1)).alias("distance"))


def within_box(cells: DataFrame, radius: Column, keys: list[str], value: str = "v") -> DataFrame:
    """Dilation of a 0/1 mask by a box of 2 ``radius`` + 1, a radius that may differ from key to key, at a cost free of it: rows first, then columns."""
    row = cells.withColumn("__r", radius).withColumn("__g", _gap(F.when(F.col(value) == 1, F.col("x")), keys, "x"))
    return row.withColumn(value, (_gap(F.when(F.col("__g") <= F.col("__r"), F.col("y")), keys, "y") <= F.col("__r")).cast("int")).drop("__g", "__r")


def ellipse_dilate(cells: DataFrame, k: int, keys: list[str], value: str = "v") -> DataFrame:
    """Dilation by a k by k ellipse: a row window for each row of the kernel, and the largest of them."""
    return _ellipse(cells, k, keys, value, F.max)


def ellipse_erode(cells: DataFrame, k: int, keys: list[str], value: str = "v") -> DataFrame:
    return _ellipse(cells, k, keys, value, F.min)


def _ellipse(cells: DataFrame, k: int, keys: list[str], value: str, best) -> DataFrame:
    r = k // 2
    widths = {dy: round((r * r - dy * dy) ** 0.5) for dy in range(-r, k - r)}
    wide = cells.select(*keys, "y", "x", *[best(value).over(Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-w, w)).alias(f"__m{dy + r}") for dy, w in widths.items()])
    spans = [F.struct(F.lit(dy).alias("dy"), F.col(f"__m{dy + r}").alias("m")) for dy in widths]
    spread = wide.select(*keys, "y", "x", F.explode(F.array(*spans)).alias("s")).select(*keys, (F.col("y") - F.col("s.dy")).alias("y"), "x", "s.m")
    found = spread.groupBy(*keys, "y", "x").agg(best("m").alias(value))
    return cells.drop(value).join(found.hint("merge"), [*keys, "y", "x"])


def moving_average(df: DataFrame, n: int, by: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("average", F.avg(value).over(w))


def running_weighted_mean(df: DataFrame, by: list[str], order: str, value: str, weight: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("average", F.try_divide(F.sum(F.col(value) * F.col(weight)).over(w), F.sum(weight).over(w)))


def running_best(df: DataFrame, by: list[str], order: str, value: str, mode: str = ">=") -> DataFrame:
    """best: the best value before a row (0, or infinity for ``<=``); is_best: whether the row beats or meets it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.min(value).over(w), F.lit(float("inf"))) if mode == "<=" else F.greatest(F.lit(0.0), F.coalesce(F.max(value).over(w), F.lit(0.0)))
    compare: dict[str, Column] = {">=": F.col(value) >= F.col("best"), ">": F.col(value) > F.col("best"), "<=": F.col(value) <= F.col("best")}
    return df.withColumn("best", best).withColumn("is_best", compare[mode])


def normalize_self(cells: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Each map to 0..1 by its own least and largest value; null where they are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return cells.withColumn(value, F.try_divide(F.col(value) - lo, hi - lo))


def normalize_global(cells: DataFrame, lo: float | None = None, hi: float | None = None, value: str = "v") -> DataFrame:
    """All maps to 0..1 by one range, cut to it; the data's own where it isn't given."""
    own = cells.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = cells.crossJoin(F.broadcast(own))  # one row
    low = F.coalesce(F.lit(lo).cast("double"), "__lo")
    high = F.coalesce(F.lit(hi).cast("double"), "__hi")
    cut = F.least(high, F.greatest(low, F.col(value)))
    return at.withColumn(value, F.try_divide(cut - low, high - low)).drop("__lo", "__hi")
