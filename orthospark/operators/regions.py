"""Connected regions of 0/1 masks in two phases: within square blocks of cells, then between blocks.

A block's set cells are labelled together in one task, as arrays. Regions of neighbouring blocks that touch are joined
by a graph whose edges lie on the seams between blocks alone, so the rounds of its contraction run on borders, not on areas.
Masks are dense: a row (raster_id, y, x, v) for every cell, with y and x from 0; other keys than raster_id, such as a
segment, can be added. Joins on cells, regions or segments are merged at every size: written tables of them are far smaller as files than as
rows, and what Spark takes for small it gathers in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from orthospark.operators.graph import connected
from orthospark.sources.scratch import written

RASTER = ["raster_id"]
#: Side of a block; a task holds a block at a time.
BLOCK = 256


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of 0 .. n-1 that each one is connected with, by edges u - v: trees are hooked on smaller ones and flattened in turn."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (flat := root[root]).tobytes() != root.tobytes():
            root = flat


def _starts(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for name in names:
        column = rows.column(name)
        null = pc.is_null(column).to_numpy()
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(rows.num_rows - 1, 0))), False).to_numpy()
        out[1:] |= differs | (null[1:] != null[:-1])
    return out


def _first_cells(rows: pa.Table, names: list[str], conn: int, block: int) -> np.ndarray:
    """Of each cell of sorted blocks: the first cell, in reading order, of its region within the block, as y * 2**32 + x."""
    y, x = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    # One number a place, a free column at either side of a block.
    place = ((np.cumsum(_starts(rows, names)) - 1) * block + y % block) * (block + 2) + x % block + 1
    at = np.arange(len(place))
    side = np.flatnonzero(np.diff(place) <= 1)  # the next in the row, or the same cell again
    us, vs = [side], [side + 1]
    above = at[y % block < block - 1]
    for d in (-1, 0, 1) if conn == 8 else (0,):
        want = place[above] + block + 2 + d
        found = np.minimum(np.searchsorted(place, want), max(len(place) - 1, 0))
        hit = place[found] == want
        us.append(above[hit])
        vs.append(found[hit])
    root = components(len(place), np.concatenate(us), np.concatenate(vs))
    return (y[root] << 32) | x[root]


def _labeller(keys: list[str], conn: int, block: int):
    names = [*keys, "__by", "__bx"]

    def labelled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        yield from rows.append_column("__first", pa.array(_first_cells(rows, names, conn, block))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = int(np.flatnonzero(_starts(held, names))[-1])
            if last:  # all blocks but the last are whole
                yield from labelled(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from labelled(held)

    return run


def block_regions(cells: DataFrame, conn: int, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Set cells with __first, the first cell of their region within their block."""
    on = cells.where("v = 1").withColumn("__by", F.floor(F.col("y") / block)).withColumn("__bx", F.floor(F.col("x") / block))
    dealt = on.repartition(*keys, "__by", "__bx").sortWithinPartitions(*keys, "__by", "__bx", "y", "x")
    schema = StructType([*on.schema.fields]).add("__first", LongType())
    return dealt.mapInArrow(_labeller(keys, conn, block), schema).drop("__by", "__bx")


def seams(regions: DataFrame, conn: int, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Distinct pairs (u, v) of regions of :func:`block_regions` that touch across a border of blocks; structs of keys and __first."""
    node = F.struct(*keys, "__first")
    aside = (-1, 0, 1) if conn == 8 else (0,)
    step = lambda dy, dx: F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
    at_end = lambda c: F.col(c) % block == block - 1
    over = lambda c, steps: F.when(at_end(c), F.array(*steps)).otherwise(F.slice(F.array(*steps), 1, 0))
    over_either = F.array_union(over("x", [step(d, 1) for d in aside]), over("y", [step(1, d) for d in aside]))
    near = regions.where(at_end("x") | at_end("y")).select(*keys, node.alias("u"), F.explode(over_either).alias("to")).select(*keys, "to.*", "u")
    # What lies over the border is in the first row or column of its block; aside of a corner it may be in the last.
    border = regions.where((F.col("x") % block).isin(0, block - 1) | (F.col("y") % block).isin(0, block - 1)).select(*keys, "y", "x", node.alias("v"))
    return near.join(border.hint("merge"), [*keys, "y", "x"]).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def label_components(cells: DataFrame, conn: int = 4, keys: list[str] = RASTER, block: int = BLOCK) -> DataFrame:
    """Set cells with comp_id: the least y * width + x of their 4- or 8-connected region."""
    on = written(block_regions(cells, conn, keys, block), "blocks")
    joined = connected(seams(on, conn, keys, block)).select(*[F.col("node").getField(k).alias(k) for k in (*keys, "__first")], F.col("root.__first").alias("__root"))
    first = F.coalesce("__root", "__first")
    width = cells.groupBy(*keys).agg((F.max("x") + 1).alias("__w"))
    place = F.shiftright(first, 32) * F.col("__w") + first.bitwiseAND(F.lit((1 << 32) - 1))
    region = [*keys, "__first"]
    named = on.select(*region).distinct().join(joined.hint("merge"), region, "left").join(width.hint("merge"), keys).select(*region, place.alias("comp_id"))
    return on.join(named.hint("merge"), region).drop("__first")
