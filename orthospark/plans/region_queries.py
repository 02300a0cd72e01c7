"""Registered queries on connected regions of masks, and the SQL each must equal.

Every query works on the whole mask. The SQL finds regions by handing the least place of a region from cell to cell."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from orthospark.operators import grids as G
from orthospark.operators import masks as M
from orthospark.operators import windows as W
from orthospark.plans import demo
from orthospark.plans import pipelines as P
from orthospark.plans.demo import MASK_SQL
from orthospark.plans.demo_queries import BOX_SQL, RASTER, query, rounded
from orthospark.sources.scratch import written

#: Within the 64 by 64 rasters of the demo.
_INSIDE = "y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63"


def regions_sql(conn: int, cells: str = "SELECT raster_id, y, x FROM mask WHERE v = 1", name: str = "", keys: str = "raster_id") -> str:
    """CTEs <name>regions(keys, y, x, comp_id) of the 4- or 8-connected regions of ``cells``."""
    near = "(-1, 0), (1, 0), (0, -1), (0, 1)" + (", (-1, -1), (-1, 1), (1, -1), (1, 1)" if conn == 8 else "")
    k, mine = [x.strip() for x in keys.split(",")], f"{name}reach"
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    of = lambda a: ", ".join(f"{a}.{x}" for x in k)
    return f"""{name}cells AS MATERIALIZED (SELECT {keys}, y, x, (y * 64 + x)::BIGINT AS id FROM ({cells})),
{name}links AS MATERIALIZED (SELECT {of("a")}, a.id AS u, b.id AS v FROM {name}cells a, (VALUES {near}) o(dy, dx), {name}cells b WHERE {same("a", "b")} AND b.y = a.y + dy AND b.x = a.x + dx),
{mine}({keys}, id, comp_id) USING KEY ({keys}, id) AS (SELECT {keys}, id, id FROM {name}cells UNION (
  SELECT {of("l")}, l.v, min(r.comp_id) FROM {mine} r JOIN {name}links l ON {same("l", "r")} AND l.u = r.id JOIN recurring.{mine} o ON {same("o", "l")} AND o.id = l.v WHERE r.comp_id < o.comp_id GROUP BY ALL)),
{name}regions AS MATERIALIZED (SELECT {keys}, (id // 64)::INT AS y, (id % 64)::INT AS x, comp_id FROM {mine})"""


_START = "WITH RECURSIVE " + MASK_SQL + ", "
_FOUR, _EIGHT = _START + regions_sql(4), _START + regions_sql(8)
_BACK = regions_sql(4, "SELECT raster_id, y, x FROM mask WHERE v = 0", "back_")


def _painted(on: str, cells: str = "mask") -> str:
    """The whole mask with v = 1 on the places that ``on`` selects."""
    return f" SELECT m.raster_id, m.y, m.x, CASE WHEN s.y IS NULL THEN 0 ELSE 1 END AS v FROM {cells} m LEFT JOIN (SELECT DISTINCT raster_id, y, x FROM ({on})) s USING (raster_id, y, x)"


@query(_FOUR + " SELECT raster_id, y, x, comp_id FROM regions")
def label_components_4(spark, sf_dir):
    return M.label_components(demo.mask(spark, sf_dir), 4).select("raster_id", "y", "x", "comp_id")


@query(_EIGHT + " SELECT raster_id, comp_id, count(*) AS area FROM regions GROUP BY ALL")
def region_areas_8(spark, sf_dir):
    return M.region_areas(M.label_components(demo.mask(spark, sf_dir), 8))


@query(_FOUR + """, a AS (SELECT raster_id, comp_id, count(*) AS n FROM regions GROUP BY ALL),
t AS (SELECT raster_id, comp_id FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY n DESC, comp_id) AS k FROM a) WHERE k = 1)""" + _painted("SELECT * FROM regions SEMI JOIN t USING (raster_id, comp_id)"))
def largest_component(spark, sf_dir):
    return M.largest_component(demo.mask(spark, sf_dir)).select("raster_id", "y", "x", "v")


#: A border cell has a side neighbour outside its region; its code tells how its border neighbours lie.
_PROPS = """border AS (SELECT r.* FROM regions r LEFT JOIN (SELECT a.raster_id, a.y, a.x, count(*) AS n FROM regions a JOIN regions b ON a.raster_id = b.raster_id AND a.comp_id = b.comp_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL) s USING (raster_id, y, x) WHERE coalesce(n, 0) < 4),
coded AS (SELECT a.raster_id, a.comp_id, a.y, a.x, 1 + 2 * count_if(abs(a.y - b.y) + abs(a.x - b.x) = 1) + 10 * count_if(abs(a.y - b.y) = 1 AND abs(a.x - b.x) = 1) AS code
  FROM border a JOIN border b ON a.raster_id = b.raster_id AND a.comp_id = b.comp_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
around AS (SELECT raster_id, comp_id, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM coded GROUP BY ALL),
props AS (SELECT a.raster_id, a.comp_id, a.area, perimeter, coalesce(4 * pi() * a.area / nullif(perimeter * perimeter, 0), 0) AS circularity FROM (SELECT raster_id, comp_id, count(*) AS area FROM regions GROUP BY ALL) a JOIN around USING (raster_id, comp_id))"""


@query(_EIGHT + ", " + _PROPS + " SELECT raster_id, comp_id, area, round(perimeter, 6) AS perimeter, round(circularity, 6) AS circularity FROM props")
def region_props(spark, sf_dir):
    return rounded(M.region_props(M.label_components(demo.mask(spark, sf_dir), 8)), "perimeter", "circularity")


_OUTER = "outer_ AS (SELECT DISTINCT raster_id, comp_id FROM back_regions WHERE y IN (0, 63) OR x IN (0, 63))"
_ON = "SELECT raster_id, y, x FROM mask WHERE v = 1 UNION ALL SELECT raster_id, y, x FROM back_regions"


@query(_START + _BACK + ", " + _OUTER + _painted(_ON + " ANTI JOIN outer_ USING (raster_id, comp_id)"))
def fill_holes(spark, sf_dir):
    return M.fill_holes(demo.mask(spark, sf_dir)).select("raster_id", "y", "x", "v")


@query(_START + _BACK + ", small AS (SELECT raster_id, comp_id FROM back_regions GROUP BY ALL HAVING count(*) <= 4)" + _painted(_ON + " SEMI JOIN small USING (raster_id, comp_id)"))
def fill_small_holes(spark, sf_dir):
    return M.fill_small_holes(demo.mask(spark, sf_dir), 0.001).select("raster_id", "y", "x", "v")


_CROSS = "SELECT a.raster_id, a.y, a.x, {f}(b.v) AS v FROM {t} a, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx), {t} b WHERE a.raster_id = b.raster_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL"


@query(_START + "wide AS MATERIALIZED (" + _CROSS.format(f="max", t="mask") + "), closed AS MATERIALIZED (" + _CROSS.format(f="min", t="wide") + "), " + regions_sql(8, "SELECT raster_id, y, x FROM closed WHERE v = 1") + ", " + _PROPS + """,
top AS (SELECT *, max(area) OVER (PARTITION BY raster_id) AS most FROM props), fit AS (SELECT raster_id, comp_id FROM top WHERE area = most OR area >= 40 AND area <= 3686 AND circularity >= 0.1)""" + _painted("SELECT * FROM regions SEMI JOIN fit USING (raster_id, comp_id)"))
def filter_regions(spark, sf_dir):
    return M.filter_regions(demo.mask(spark, sf_dir), 0.01, 0.1).select("raster_id", "y", "x", "v")


#: Places of a raster without data: where nothing or much was sold.
_NODATA = "nodata AS (SELECT raster_id, y, x, v = 0 OR v > 150 AS nodata FROM raster)"


def _nodata(spark, sf_dir):
    return demo.raster(spark, sf_dir).select("raster_id", "y", "x", ((F.col("v") == 0) | (F.col("v") > 150)).alias("nodata"))


@query(_FOUR + ", " + _NODATA + """, grown AS (SELECT DISTINCT r.raster_id, r.comp_id, r.y + a.i AS y, r.x + b.i AS x FROM regions r, range(-1, 3) a(i), range(-1, 3) b(i)),
share AS (SELECT raster_id, comp_id, avg(nodata::INT) AS share FROM grown JOIN nodata USING (raster_id, y, x) GROUP BY ALL),
keep AS (SELECT raster_id, comp_id FROM (SELECT raster_id, comp_id, count(*) AS area FROM regions GROUP BY ALL) JOIN share USING (raster_id, comp_id) WHERE area >= 3 AND share <= 0.12)""".replace("range(-1, 3)", "range(-2, 2)") + _painted("SELECT * FROM regions SEMI JOIN keep USING (raster_id, comp_id)"))
def drop_nodata_segments(spark, sf_dir):
    """An even box of four, mirrored: a cell reaches two places back and one on, so a place is in the grown form if a cell lies one back to two on."""
    return M.drop_nodata_segments(demo.mask(spark, sf_dir), _nodata(spark, sf_dir), 0.12, 4, 3).select("raster_id", "y", "x", "v")


@query(_FOUR + """, s AS (SELECT g.raster_id, comp_id, round(stddev_pop(r.v), 9) AS std FROM regions g JOIN raster r USING (raster_id, y, x) GROUP BY ALL),
z AS (SELECT *, (std - avg(std) OVER (PARTITION BY raster_id)) / nullif(stddev_pop(std) OVER (PARTITION BY raster_id), 0) AS z FROM s), gone AS (SELECT raster_id, comp_id FROM z WHERE z < -0.9)""" + _painted("SELECT * FROM regions ANTI JOIN gone USING (raster_id, comp_id)"))
def drop_low_variance_segments(spark, sf_dir):
    return M.drop_low_variance_segments(demo.mask(spark, sf_dir), demo.raster(spark, sf_dir).withColumn("b", F.lit(0)), 0.9).select("raster_id", "y", "x", "v")


@query(_FOUR + ", a AS (SELECT raster_id, comp_id FROM regions GROUP BY ALL HAVING count(*) < 3) SELECT raster_id, y, x FROM regions ANTI JOIN a USING (raster_id, comp_id)")
def remove_labels(spark, sf_dir):
    regions = M.label_components(demo.mask(spark, sf_dir), 4)
    return G.remove_labels(regions, M.region_areas(regions).where("area < 3")).select("raster_id", "y", "x")


@query(_FOUR + " SELECT raster_id, comp_id, round(stddev_pop(r.v), 5) AS std FROM regions g JOIN raster r USING (raster_id, y, x) GROUP BY ALL")
def segment_spread(spark, sf_dir):
    regions = M.label_components(demo.mask(spark, sf_dir), 4)
    return rounded(M.segment_spread(regions, demo.raster(spark, sf_dir).withColumn("b", F.lit(0))), "std", places=5).drop("b")


@query(_FOUR + """, s AS (SELECT raster_id, comp_id, round(stddev_pop(r.v), 5) AS std FROM regions g JOIN raster r USING (raster_id, y, x) GROUP BY ALL),
z AS (SELECT *, (std - avg(std) OVER (PARTITION BY raster_id)) / nullif(stddev_pop(std) OVER (PARTITION BY raster_id), 0) AS z FROM s) SELECT raster_id, comp_id, coalesce(z < -0.9, false) AS outlier FROM z""")
def zscore_outliers(spark, sf_dir):
    return M.zscore_outliers(segment_spread(spark, sf_dir).withColumn("b", F.lit(0)), 0.9)


#: One depth of splitting with a 3 by 3 box: a region that erodes into several large parts is replaced by them, grown back within it.
_SPLIT = _START + "wide AS MATERIALIZED (" + BOX_SQL.format(f="max", t="mask", lo=1, hi=1) + "), " + regions_sql(8, "SELECT raster_id, y, x FROM wide WHERE v = 1", "seg_") + """,
segs AS (SELECT raster_id, comp_id AS seg, y, x FROM seg_regions),
eroded AS MATERIALIZED (SELECT a.raster_id, a.seg, a.y, a.x FROM segs a, range(-1, 2) i(i), range(-1, 2) j(i), segs b WHERE b.raster_id = a.raster_id AND b.seg = a.seg AND b.y = a.y + i.i AND b.x = a.x + j.i GROUP BY ALL
  HAVING count(*) = (least(a.y + 1, 63) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, 63) - greatest(a.x - 1, 0) + 1)), """ + regions_sql(8, "SELECT * FROM eroded", "core_", "raster_id, seg") + """,
sizes AS (SELECT *, sum(n) OVER (PARTITION BY raster_id, seg) AS whole FROM (SELECT raster_id, seg, comp_id, count(*) AS n FROM core_regions GROUP BY ALL)),
large AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY raster_id, seg) AS parts FROM sizes WHERE n >= floor(whole * 0.05)) WHERE parts > 1),
back AS (SELECT DISTINCT s.raster_id, s.seg, l.comp_id, s.y, s.x FROM core_regions c JOIN large l USING (raster_id, seg, comp_id), range(-1, 2) i(i), range(-1, 2) j(i), segs s WHERE s.raster_id = c.raster_id AND s.seg = c.seg AND s.y = c.y + i.i AND s.x = c.x + j.i),
parts AS (SELECT raster_id, seg, comp_id, y, x FROM back UNION ALL SELECT raster_id, seg, -1, y, x FROM segs WHERE (raster_id, seg) NOT IN (SELECT (raster_id, seg) FROM large))"""


@query(_SPLIT + " SELECT raster_id, count(*) AS area, min(y * 64 + x)::BIGINT AS first_cell FROM parts GROUP BY raster_id, seg, comp_id")
def split_weak_bridges(spark, sf_dir):
    parts = M.split_weak_bridges(W.dilate(demo.mask(spark, sf_dir), 3, RASTER), 3, 0.05, 1)
    return parts.groupBy("raster_id", "comp_id").agg(F.count("*").alias("area"), F.min(F.col("y").cast("long") * 64 + F.col("x")).alias("first_cell")).drop("comp_id")


#: Of the parts: their form grown by a cross and filled, and the parts of whose form little lacks data.
_LOW = f"""shape AS (SELECT DISTINCT raster_id, seg, comp_id, y + i.i AS y, x + j.i AS x FROM parts, range(-1, 2) i(i), range(-1, 2) j(i) WHERE abs(i.i) + abs(j.i) <= 1),
inside AS MATERIALIZED (SELECT * FROM shape WHERE {_INSIDE}),
box AS (SELECT raster_id, seg, comp_id, greatest(min(y) - 1, 0) AS y0, least(max(y) + 1, 63) AS y1, greatest(min(x) - 1, 0) AS x0, least(max(x) + 1, 63) AS x1 FROM inside GROUP BY ALL),
gaps AS (SELECT b.raster_id, b.seg, b.comp_id AS part, i.i AS y, j.i AS x FROM box b, range(64) i(i), range(64) j(i) WHERE i.i BETWEEN y0 AND y1 AND j.i BETWEEN x0 AND x1 AND (b.raster_id, b.seg, b.comp_id, i.i, j.i) NOT IN (SELECT (raster_id, seg, comp_id, y, x) FROM inside)),
""" + regions_sql(4, "SELECT * FROM gaps", "gap_", "raster_id, seg, part") + """,
open_ AS (SELECT DISTINCT g.raster_id, g.seg, g.part, g.comp_id FROM gap_regions g JOIN box b ON b.raster_id = g.raster_id AND b.seg = g.seg AND b.comp_id = g.part WHERE g.y IN (y0, y1) OR g.x IN (x0, x1)),
full_ AS (SELECT raster_id, seg, comp_id AS part, y, x FROM inside UNION ALL SELECT raster_id, seg, part, y, x FROM gap_regions g ANTI JOIN open_ USING (raster_id, seg, part, comp_id)),
keep AS (SELECT raster_id, seg, part AS comp_id FROM full_ JOIN nodata USING (raster_id, y, x) GROUP BY ALL HAVING count_if(nodata) <= 60 AND avg(nodata::INT) <= 0.3)"""


@query(_SPLIT + ", " + _NODATA + ", " + _LOW + _painted("SELECT * FROM parts SEMI JOIN keep USING (raster_id, seg, comp_id)"))
def keep_low_nodata_segments(spark, sf_dir):
    wide = W.dilate(demo.mask(spark, sf_dir), 3, RASTER)
    return M.keep_low_nodata_segments(wide, _nodata(spark, sf_dir), 1, 60, 0.3, most_width=3, least_share=0.05, depth=1).select("raster_id", "y", "x", "v")


def _split_sql(segs: str, widths: range, depth: int, share: float) -> str:
    """CTEs up to final(raster_id, seg, y, x): ``segs(raster_id, seg, y, x)`` split at so many depths by boxes of the widths, in turn."""
    out, done = [], []
    for d in range(depth):
        open_, split = segs, []
        for k in widths:
            t, r = f"d{d}k{k}_", k // 2
            around = " * ".join(f"(least(a.{c} + {r}, 63) - greatest(a.{c} - {r}, 0) + 1)" for c in "yx")
            box = f"range({-r}, {r + 1}) i(i), range({-r}, {r + 1}) j(i)"
            out.append(f"""{t}eroded AS MATERIALIZED (SELECT a.raster_id, a.seg, a.y, a.x FROM {open_} a, {box}, {open_} b WHERE b.raster_id = a.raster_id AND b.seg = a.seg AND b.y = a.y + i.i AND b.x = a.x + j.i GROUP BY ALL HAVING count(*) = {around})""")
            out.append(regions_sql(8, f"SELECT * FROM {t}eroded", t, "raster_id, seg"))
            out.append(f"""{t}sizes AS (SELECT *, sum(n) OVER (PARTITION BY raster_id, seg) AS whole FROM (SELECT raster_id, seg, comp_id, count(*) AS n FROM {t}regions GROUP BY ALL)),
{t}large AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY raster_id, seg) AS parts FROM {t}sizes WHERE n >= floor(whole * {share})) WHERE parts > 1),
{t}back AS MATERIALIZED (SELECT DISTINCT s.raster_id, s.seg || '/{k}/' || l.comp_id AS seg, s.y, s.x FROM {t}regions c JOIN {t}large l USING (raster_id, seg, comp_id), {box}, {open_} s WHERE s.raster_id = c.raster_id AND s.seg = c.seg AND s.y = c.y + i.i AND s.x = c.x + j.i),
{t}open AS MATERIALIZED (SELECT * FROM {open_} WHERE (raster_id, seg) NOT IN (SELECT (raster_id, seg) FROM {t}large))""")
            open_ = f"{t}open"
            split.append(f"SELECT * FROM {t}back")
        done.append(f"SELECT * FROM {open_}")
        segs = f"d{d}split"
        out.append(f"{segs} AS MATERIALIZED ({' UNION ALL '.join(split)})")
    return ",\n".join(out) + f", final AS MATERIALIZED ({' UNION ALL '.join([*done, f'SELECT * FROM {segs}'])})"


#: Squares of 8 by 8, and of 4 by 4 between them, wherever some place of the mask is set: bodies with bridges of several widths.
_BODIES = """bodies AS MATERIALIZED (SELECT m.raster_id, m.y, m.x, greatest(a.v, b.v * c.v) AS v FROM mask m JOIN mask a ON a.raster_id = m.raster_id AND a.y = m.y // 8 AND a.x = m.x // 8
  JOIN mask b ON b.raster_id = m.raster_id AND b.y = 32 + m.y // 4 AND b.x = m.x // 4 JOIN mask c ON c.raster_id = m.raster_id AND c.y = 32 + m.y // 4 AND c.x = 16 + m.x // 4)"""


def _bodies(spark, sf_dir):
    mask = demo.mask(spark, sf_dir)
    of = lambda side, dy, dx, name: mask.select("raster_id", (F.col("y") - dy).alias(f"{name}_y"), (F.col("x") - dx).alias(f"{name}_x"), F.col("v").alias(name)).where(f"{name}_y BETWEEN 0 AND {side} AND {name}_x BETWEEN 0 AND {side}")
    at = demo.raster(spark, sf_dir).select("raster_id", "y", "x", *[F.floor(F.col(c) / k).cast("int").alias(f"{n}_{c}") for n, k in (("a", 8), ("b", 4), ("c", 4)) for c in ("y", "x")])
    for name, side, dy, dx in (("a", 7, 0, 0), ("b", 15, 32, 0), ("c", 15, 32, 16)):
        # Merged: without its values a grid of places looks as small to Spark as the list of rasters.
        at = at.join(of(side, dy, dx, name).hint("merge"), ["raster_id", f"{name}_y", f"{name}_x"])
    return at.select("raster_id", "y", "x", F.greatest(F.col("a"), F.col("b") * F.col("c")).alias("v"))


@query(_START + _BODIES + ", " + regions_sql(8, "SELECT raster_id, y, x FROM bodies WHERE v = 1", "seg_") + """,
segs AS MATERIALIZED (SELECT raster_id, comp_id::VARCHAR AS seg, y, x FROM seg_regions), """ + _split_sql("segs", range(3, 8, 2), 2, 0.02) + """
SELECT raster_id, count(*) AS area, min(y * 64 + x)::BIGINT AS first_cell, sum(y * 64 + x)::BIGINT AS places FROM final GROUP BY raster_id, seg""")
def split_bridges_deep(spark, sf_dir):
    """Two depths, boxes of 3 to 7."""
    parts = M.split_weak_bridges(written(_bodies(spark, sf_dir), "bodies"), 7, 0.02, 2)
    place = F.col("y").cast("long") * 64 + F.col("x")
    return parts.groupBy("raster_id", "comp_id").agg(F.count("*").alias("area"), F.min(place).alias("first_cell"), F.sum(place).alias("places")).drop("comp_id")


def _ellipse_sql(cells: str, k: int, best: str) -> str:
    """The best value over a k by k ellipse of the places there are."""
    r = k // 2
    places = ", ".join(f"({dy}, {dx})" for dy in range(-r, r + 1) for w in [round((r * r - dy * dy) ** 0.5)] for dx in range(-w, w + 1))
    return f"SELECT a.raster_id, a.y, a.x, {best}(b.v) AS v FROM {cells} a, (VALUES {places}) o(dy, dx), {cells} b WHERE a.raster_id = b.raster_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL"


def _adaptive_sql(mask: str, threshold: float, least: int, sizes: tuple[int, ...], least_change: int) -> str:
    """CTEs up to closed_(raster_id, y, x, v): every closing of every raster, and the one at which the raster stops."""
    out, cells = [], mask
    facts = lambda n: f"{n}facts AS (SELECT raster_id, count(*) AS n, count_if(area > {threshold} * 4096) AS large, count_if(area > 1.5 * {threshold} * 4096) AS larger, count_if(area > 2 * {threshold} * 4096) AS largest FROM (SELECT raster_id, comp_id, count(*) AS area FROM {n}regions GROUP BY ALL) GROUP BY ALL)"
    for i, k in enumerate((0, *sizes)):
        n = f"c{k}_"
        if i:
            out += [f"{n}wide AS MATERIALIZED ({_ellipse_sql(cells, k, 'max')})", f"{n}mask AS MATERIALIZED ({_ellipse_sql(f'{n}wide', k, 'min')})"]
            cells = f"{n}mask"
        out += [regions_sql(8, f"SELECT raster_id, y, x FROM {cells} WHERE v = 1", n), facts(n)]
    names = f"(SELECT DISTINCT raster_id FROM {mask})"
    levels = [f"SELECT 0 AS level, r.raster_id, 0 AS n, coalesce(larger, 0) >= {least} OR coalesce(largest, 0) >= 1 AS enough FROM {names} r LEFT JOIN c0_facts USING (raster_id)"]
    levels += [f"SELECT {i}, r.raster_id, coalesce(n, 0) + 1, coalesce(large, 0) >= {least} FROM {names} r LEFT JOIN c{k}_facts USING (raster_id)" for i, k in enumerate(sizes, 1)]
    out.append(f"levels AS ({' UNION ALL '.join(levels)})")
    out.append(f"stops AS (SELECT raster_id, coalesce(min(level) FILTER (enough OR level > 0 AND abs(n - before) < {least_change}), {len(sizes)}) AS level FROM (SELECT *, lag(n) OVER (PARTITION BY raster_id ORDER BY level) AS before FROM levels) GROUP BY ALL)")
    masks = [f"SELECT {i} AS level, * FROM {m}" for i, m in enumerate((mask, *[f"c{k}_mask" for k in sizes]))]
    out.append(f"closed_ AS (SELECT raster_id, y, x, v, level FROM ({' UNION ALL '.join(masks)}) SEMI JOIN stops USING (raster_id, level))")
    return ",\n".join(out)


@query(_START + "bright AS MATERIALIZED (SELECT raster_id, y, x, CASE WHEN v > 2 * m THEN 1 ELSE 0 END AS v FROM raster JOIN (SELECT raster_id, round(avg(v), 6) AS m FROM raster GROUP BY raster_id) USING (raster_id)),\n" + _adaptive_sql("bright", 0.0083, 1, (3, 5, 7), 4) + " SELECT raster_id, y, x, v FROM closed_")
def adaptive_close(spark, sf_dir):
    """Rasters stop at different kernels."""
    return M.adaptive_close(demo.mask(spark, sf_dir, times=2), 0.0083, 1, (3, 5, 7), 4).select("raster_id", "y", "x", "v")


#: Blocks of 16 by 16 within the grown mask as candidate segments, on an image of 0 to 255.
_BLOCKS = MASK_SQL + ", wide AS MATERIALIZED (" + BOX_SQL.format(f="max", t="mask", lo=1, hi=1) + """),
seg AS MATERIALIZED (SELECT raster_id, (y // 16 * 4 + x // 16)::INT AS seg_id, y, x FROM wide WHERE v = 1),
facts AS (SELECT seg_id, s.raster_id, count(*) AS area, avg(least(r.v, 255)) AS mean FROM seg s JOIN raster r USING (raster_id, y, x) GROUP BY ALL),
keep AS (SELECT raster_id, seg_id FROM facts WHERE area / 4096 >= 0.05 AND mean / 255 >= 0.1),
eroded AS (SELECT a.raster_id, a.y, a.x FROM (SELECT * FROM seg SEMI JOIN keep USING (raster_id, seg_id)) a, range(-1, 2) i(i), range(-1, 2) j(i), seg b WHERE b.raster_id = a.raster_id AND b.seg_id = a.seg_id AND b.y = a.y + i.i AND b.x = a.x + j.i GROUP BY ALL
  HAVING count(*) = (least(a.y + 1, 63) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, 63) - greatest(a.x - 1, 0) + 1))"""


@query("WITH " + _BLOCKS + _painted("SELECT * FROM eroded"))
def candidate_segments(spark, sf_dir):
    wide = W.dilate(demo.mask(spark, sf_dir), 3, RASTER).where("v = 1")
    segments = wide.select("raster_id", (F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)).cast("int").alias("seg_id"), "y", "x")
    image = demo.raster(spark, sf_dir).withColumn("v", F.least("v", F.lit(255.0)))
    return M.candidate_segments(segments, image, 0.05, 0.1).select("raster_id", "y", "x", "v")


#: The upper left quarter of each raster as a small image, squares of 8 by 8 of the grown mask as its candidate segments; what is left of them at twice
#: the size, without regions that lack data or vary little, and the largest region outside.
_CANDIDATES = _START + "wide AS MATERIALIZED (" + BOX_SQL.format(f="max", t="mask", lo=1, hi=1) + "), " + _NODATA + """,
quarter AS MATERIALIZED (SELECT raster_id, y, x, least(v, 255) AS v FROM raster WHERE y < 32 AND x < 32),
seg AS MATERIALIZED (SELECT raster_id, y // 8 * 4 + x // 8 AS seg_id, y, x FROM wide WHERE v = 1 AND y < 32 AND x < 32 AND (y % 8 < 6 OR x % 8 < 3)),
keep AS (SELECT raster_id, seg_id FROM (SELECT s.raster_id, seg_id, count(*) / 1024 AS share, avg(q.v) AS mean FROM seg s JOIN quarter q USING (raster_id, y, x) GROUP BY ALL) WHERE share >= 0.04 AND (mean / 255 >= 0.115 OR share >= 0.3)),
eroded AS (SELECT a.raster_id, a.y, a.x FROM (SELECT * FROM seg SEMI JOIN keep USING (raster_id, seg_id)) a, range(-1, 2) i(i), range(-1, 2) j(i), seg b WHERE b.raster_id = a.raster_id AND b.seg_id = a.seg_id AND b.y = a.y + i.i AND b.x = a.x + j.i GROUP BY ALL
  HAVING count(*) = (least(a.y + 1, 31) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, 31) - greatest(a.x - 1, 0) + 1)),
small AS MATERIALIZED (""" + _painted("SELECT * FROM eroded", "quarter") + """),
m1 AS MATERIALIZED (SELECT raster_id, i.i::INT AS y, j.i::INT AS x, v FROM small, range(64) i(i), range(64) j(i) WHERE y = i.i // 2 AND x = j.i // 2),
""" + regions_sql(4, "SELECT raster_id, y, x FROM m1 WHERE v = 1", "a_") + """,
a_grown AS (SELECT DISTINCT r.raster_id, r.comp_id, r.y + a.i AS y, r.x + b.i AS x FROM a_regions r, range(-1, 2) a(i), range(-1, 2) b(i)),
a_share AS (SELECT raster_id, comp_id, avg(nodata::INT) AS share FROM a_grown JOIN nodata USING (raster_id, y, x) GROUP BY ALL),
a_keep AS (SELECT raster_id, comp_id FROM (SELECT raster_id, comp_id, count(*) AS area FROM a_regions GROUP BY ALL) JOIN a_share USING (raster_id, comp_id) WHERE area >= 20 AND share <= 0.345),
m2 AS MATERIALIZED (""" + _painted("SELECT * FROM a_regions SEMI JOIN a_keep USING (raster_id, comp_id)", "m1") + "),\n" + regions_sql(4, "SELECT raster_id, y, x FROM m2 WHERE v = 1", "b_") + """,
b_std AS (SELECT g.raster_id, comp_id, stddev_pop(r.v) AS std FROM b_regions g JOIN raster r USING (raster_id, y, x) GROUP BY ALL),
b_gone AS (SELECT raster_id, comp_id FROM (SELECT *, (std - avg(std) OVER (PARTITION BY raster_id)) / nullif(stddev_pop(std) OVER (PARTITION BY raster_id), 0) AS z FROM b_std) WHERE z < -0.8),
m3 AS MATERIALIZED (""" + _painted("SELECT * FROM b_regions ANTI JOIN b_gone USING (raster_id, comp_id)", "m2") + "),\n" + regions_sql(4, "SELECT raster_id, y, x FROM m3 WHERE v = 0", "c_") + """,
c_top AS (SELECT raster_id, comp_id FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY n DESC, comp_id) AS k FROM (SELECT raster_id, comp_id, count(*) AS n FROM c_regions GROUP BY ALL)) WHERE k = 1)
SELECT m3.raster_id, m3.y, m3.x, CASE WHEN t.comp_id IS NULL THEN -999 ELSE 0 END AS v, m3.v AS inside, m2.v AS held, m1.v AS grown FROM m3 JOIN m2 USING (raster_id, y, x) JOIN m1 USING (raster_id, y, x)
LEFT JOIN (SELECT * FROM c_regions SEMI JOIN c_top USING (raster_id, comp_id)) t USING (raster_id, y, x)"""


@query(_CANDIDATES.replace(", m3.v AS inside, m2.v AS held, m1.v AS grown FROM m3 JOIN m2 USING (raster_id, y, x) JOIN m1 USING (raster_id, y, x)", " FROM m3"))
def segment_candidates(spark, sf_dir):
    raster = demo.raster(spark, sf_dir)
    quarter = "y < 32 AND x < 32"
    wide = W.dilate(demo.mask(spark, sf_dir), 3, RASTER).where("v = 1").where(quarter).where("y % 8 < 6 OR x % 8 < 3")
    segments = wide.select("raster_id", (F.floor(F.col("y") / 8) * 4 + F.floor(F.col("x") / 8)).cast("int").alias("seg_id"), "y", "x")
    image = raster.where(quarter).withColumn("v", F.least("v", F.lit(255.0)))
    mask = P.segment_candidates(image, segments, raster.withColumn("b", F.lit(0)), _nodata(spark, sf_dir), 64, 64, 0.04, 0.115, 0.345, 3, 20, 0.8)
    return mask.select("raster_id", "y", "x", "v")


def _stage(name: str, source: str, sql: str) -> str:
    """CTEs that read ``mask``, reading ``source`` instead, with ``name`` before each of their own names."""
    own = set(re.findall(r"(\w+)(?:\([^()]*\))? (?:USING KEY \([^()]*\) )?AS (?:MATERIALIZED )?\(", sql))
    renamed = re.sub(rf"\b({'|'.join(sorted(own))})\b", rf"{name}\1", sql)
    return re.sub(r"\bmask\b", source, renamed)


def _green_sql(name: str, source: str, kernel: int) -> str:
    """CTEs from a mask of green places to <name>9_out, as the whole job makes it."""
    r, out = kernel // 2, "out AS MATERIALIZED ("
    box = lambda f, t, to: f"{to} AS MATERIALIZED (" + BOX_SQL.format(f=f, t=t, lo=r, hi=r) + ")"
    small = _BACK + ", small AS (SELECT raster_id, comp_id FROM back_regions GROUP BY ALL HAVING count(*) <= 4), " + out + _painted(_ON + " SEMI JOIN small USING (raster_id, comp_id)") + ")"
    cross = "wide AS MATERIALIZED (" + _CROSS.format(f="max", t="mask") + "), closed AS MATERIALIZED (" + _CROSS.format(f="min", t="wide") + "), "
    fits = _PROPS + ", top AS (SELECT *, max(area) OVER (PARTITION BY raster_id) AS most FROM props), fit AS (SELECT raster_id, comp_id FROM top WHERE area = most OR area >= 40 AND area <= 3686 AND circularity >= 0.1), "
    filtered = cross + regions_sql(8, "SELECT raster_id, y, x FROM closed WHERE v = 1") + ", " + fits + out + _painted("SELECT * FROM regions SEMI JOIN fit USING (raster_id, comp_id)") + ")"
    cut = regions_sql(8, "SELECT raster_id, y, x FROM mask WHERE v = 1", "seg_") + ", " + _SPLIT[_SPLIT.index("segs AS") :] + ", " + _LOW + ", " + out + _painted("SELECT * FROM parts SEMI JOIN keep USING (raster_id, seg, comp_id)") + ")"
    stages = [
        ", ".join([box("max", "mask", "a"), box("min", "a", "b"), box("min", "b", "c"), box("max", "c", "out")]), small, _adaptive_sql("mask", 0.05, 3, (3, 5), 100).replace("closed_ AS", "out AS MATERIALIZED"), small, filtered, cut, filtered,
        out + BOX_SQL.format(f="max", t="mask", lo=1, hi=1) + ")", _BACK + ", " + _OUTER + ", " + out + _painted(_ON + " ANTI JOIN outer_ USING (raster_id, comp_id)") + ")",
    ]
    done = []
    for i, sql in enumerate(stages, 1):
        done.append(_stage(f"{name}{i}_", source, sql))
        source = f"{name}{i}_out"
    return ",\n".join(done)


#: Green bodies, black where much was sold, as an image; no raster is left without any, so none goes through again.
_GREEN = _START + _BODIES + ", nodata AS (SELECT raster_id, y, x, v > 200 AS nodata FROM raster), green AS MATERIALIZED (SELECT raster_id, y, x, CASE WHEN b.v = 1 AND NOT nodata THEN 1 ELSE 0 END AS v FROM bodies b JOIN nodata USING (raster_id, y, x)),\n"
_GREEN += _green_sql("g", "green", 3) + " SELECT raster_id, y, x, CASE WHEN v = 1 THEN -999 ELSE 0 END AS v FROM g9_out"


@query(_GREEN)
def segment_green(spark, sf_dir):
    """Images whose bodies are green, black where there is no data, grey elsewhere."""
    without = demo.raster(spark, sf_dir).select("raster_id", "y", "x", (F.col("v") > 200).alias("nodata"))
    colour = lambda green: F.when(F.col("nodata"), 0).when(F.col("v") == 1, green).otherwise(10)
    image = written(_bodies(spark, sf_dir).join(without.hint("merge"), ["raster_id", "y", "x"]).select("raster_id", "y", "x", colour(10).alias("r"), colour(200).alias("g"), colour(10).alias("b")), "image")
    p = P.GreenMask(
        kernel=3, hole_share=0.001, close_threshold=0.05, close_sizes=(3, 5), least_share=0.01, least_circularity=0.1, border=1, most_nodata_cells=60, most_nodata_share=0.3,
        bridge_width=3, bridge_share=0.05, bridge_depth=1, buffer=1, least_covered=0.0,
    )
    return P.segment_green(image, p).select("raster_id", "y", "x", "v")
