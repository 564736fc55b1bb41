"""Queries on regions, footprints and tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import over, tidy
from ..operators import boxes as X
from ..operators import footprints as G
from ..operators import peaks as P
from ..sources import movies as M
from ..sources.store import materialise
from .movie import BEST_SQL, PIXELS, SIDE, closing_sql, frames, r

TILES = P.tiles(SIDE, SIDE, 2, 2, 1)
TILES_SQL = "tiles(tile, y0, y1, x0, x1, margin) AS (VALUES " + ", ".join(str(t) for t in TILES) + ")"


def tile_table(spark):
    return spark.createDataFrame(TILES, "tile int, y0 int, y1 int, x0 int, x1 int, margin int")


def peaks(spark, d):
    """peaks(segid, t, y, x, radius): the best peak of every pixel, numbered by place."""
    from .movie import _best

    return _best(spark, d).select((F.col("y") * SIDE + F.col("x")).cast("int").alias("segid"), "t", "y", "x", "radius")


def segment_mask(spark, d):
    return G.grow(frames(spark, d), peaks(spark, d), SIDE, SIDE).select("segid", "y", "x")


def rescale_segments(spark, d):
    rows = G.grow(frames(spark, d), peaks(spark, d), SIDE, SIDE)
    w = Window.partitionBy("segid")
    return rows.select("segid", "y", "x", tidy(over(F.col("v") - F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w))).alias("a"))


def make_footprints(spark, d):
    return G.make_footprints(frames(spark, d), peaks(spark, d), SIDE, SIDE, 4).withColumn("a", tidy("a")).where("a > 0")


def positive(spark, d):
    return G.positive_frames(frames(spark, d), SIDE)


def dense_footprints(spark, d):
    """Stored footprints laid out again as whole images: sum and number of places of each."""
    dense = G.densify(label_footprints(spark, d), SIDE, SIDE)
    return dense.select("segid", F.size("px").alias("n"), tidy(F.aggregate("px", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def _stored(spark, d, rows):
    """Footprints written as boxes and read again."""
    return materialise(X.boxed(rows), "boxes")


def footprint_boxes(spark, d):
    """The boxes of the stored footprints and what they hold."""
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    return _stored(spark, d, positive(spark, d)).select("segid", "y0", "y1", "x0", "x1", F.size("w").alias("n"), tidy(total).alias("total"))


def boxed_footprints(spark, d):
    """Footprints as they come back from their boxes."""
    return X.unboxed(_stored(spark, d, positive(spark, d))).select("segid", "y", "x", tidy("a").alias("a"))


def boxed_overlap(spark, d):
    """The most overlapping footprint, from boxes."""
    return X.overlap(_stored(spark, d, label_footprints(spark, d)), label_cells(spark, d)).select("segid", "max_dup_id", tidy("max_dup").alias("max_dup"))


def boxed_tiles(spark, d):
    """Tile membership, from boxes."""
    return X.tile_members(_stored(spark, d, positive(spark, d)), centre_cells(spark, d), tile_table(spark))


def footprint_area(spark, d):
    return G.measures(positive(spark, d)).select("segid", tidy("asum").alias("asum"), "area")


def footprint_aspect(spark, d):
    return G.measures(positive(spark, d)).select("segid", tidy("aratio", 4).alias("aratio"))


def base_threshold(spark, d):
    """Weights above 0.3 stretched to 0..1."""
    out = positive(spark, d).withColumn("a", F.greatest(F.lit(0.0), (F.col("a") - 0.3) / 0.7))
    return out.where("a > 0").select("segid", "y", "x", tidy("a").alias("a"))


def centre_cells(spark, d):
    """Cells of all frames: centres with a radius from the area."""
    p = positive(spark, d)
    area = p.groupBy("segid").agg(F.sqrt(F.count("*") / 3.0).alias("radius"))
    return G.centres(p).join(area, "segid")


def footprint_centres(spark, d):
    return centre_cells(spark, d).select("segid", "y", "x", tidy("radius").alias("radius"))


def nearest_neighbor(spark, d):
    """Nearest other class mean, by the centres of the mean footprints of the labels."""
    return G.nearest(label_cells(spark, d)).select("segid", "min_dist_id", tidy("min_dist").alias("min_dist"))


def label_footprints(spark, d):
    """footprints(segid = label): positive part of the mean frame of each label, over its maximum."""
    rows = M.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    mean = rows.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    px = mean.select(F.col("label").alias("t"), (F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), "v")
    return G.positive_parts(px)


def label_cells(spark, d):
    p = label_footprints(spark, d)
    return G.centres(p).join(p.groupBy("segid").agg(F.sqrt(F.count("*") / 3.0).alias("radius")), "segid")


def max_overlap(spark, d):
    return G.overlap(label_footprints(spark, d), label_cells(spark, d)).select("segid", "max_dup_id", tidy("max_dup").alias("max_dup"))


def mutual_duplicates(spark, d):
    """Pairs of label footprints each of which exceeds 0.2 at the other's centre, by two equi-joins."""
    p, c = label_footprints(spark, d), label_cells(spark, d).select("segid", "y", "x")
    at = c.join(p.where("a > 0.2").select(F.col("segid").alias("o"), "y", "x"), ["y", "x"]).where("segid <> o").select("segid", "o")
    return at.join(at.select(F.col("o").alias("segid"), F.col("segid").alias("o")), ["segid", "o"]).select(F.col("segid").alias("i"), F.col("o").alias("j"))


def tiles(spark, d):
    """Tiles with the number of centres that each owns."""
    c = centre_cells(spark, d)
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    owned = c.join(F.broadcast(tile_table(spark)), inside).groupBy("tile").agg(F.count("*").alias("n"))
    return tile_table(spark).join(owned, "tile", "left").select("tile", "y0", "y1", "x0", "x1", "margin", F.coalesce("n", F.lit(0)).alias("n"))


def tile_assign(spark, d):
    """How many pixels of the movie each tile reads, halo included, and their sum."""
    m = F.col("margin")
    px = M.pixels(frames(spark, d))
    inside = (F.col("y") >= F.col("y0") - m) & (F.col("y") < F.col("y1") + m) & (F.col("x") >= F.col("x0") - m) & (F.col("x") < F.col("x1") + m)
    return px.join(F.broadcast(tile_table(spark)), inside).groupBy("tile").agg(F.count("*").alias("n"), tidy(F.sum("v")).alias("total"))


def clip_unclip(spark, d):
    """The movie cut into a tile and pasted back: zeros elsewhere."""
    px = M.pixels(frames(spark, d))
    back = G.off_grid(G.on_grid(px, TILES[3], SIDE, SIDE), TILES[3])
    return px.select("t", "y", "x").join(back, ["t", "y", "x"], "left").select("t", "y", "x", tidy(F.coalesce("v", F.lit(0.0))).alias("v"))


def active_cells(spark, d):
    return G.tile_members(positive(spark, d), centre_cells(spark, d), tile_table(spark))


def clean_footprints(spark, d):
    """Refound centre, radius and firmness of the labels' mean footprints."""
    out = G.clean_footprints(label_footprints(spark, d), SIDE, SIDE, [0.8, 1.2, 1.8], 4)
    return out.groupBy("segid").agg(F.first("cy").alias("y"), F.first("cx").alias("x"), tidy(F.first("radius")).alias("radius"), tidy(F.first("firmness")).alias("firmness"), F.count("*").alias("area"))


#: plog: every peak's filtered frame; grown: the region from its place.
_GROWN = BEST_SQL + """, plog AS (SELECT b.y * 8 + b.x AS segid, s.y, s.x, s.v, s.y = b.y AND s.x = b.x AS seed FROM best b JOIN scales s ON s.t = b.t AND s.ri = b.ri
), grown(segid, y, x, v) AS (
  SELECT segid, y, x, v FROM plog WHERE seed
  UNION
  SELECT p.segid, p.y, p.x, p.v FROM grown g JOIN plog p ON p.segid = g.segid AND abs(p.y - g.y) <= 1 AND abs(p.x - g.x) <= 1 AND p.v > 0 AND p.v <= g.v
)"""
POSITIVE = PIXELS + ", tops AS (SELECT t, max(v) AS top FROM pixels GROUP BY t), foot AS (SELECT p.t AS segid, y, x, v / top AS a FROM pixels p JOIN tops USING (t) WHERE v > 0 AND top > 0)"
CENTRES = POSITIVE + """, centres AS (SELECT segid, y, x, radius FROM (
  SELECT segid, y, x, row_number() OVER (PARTITION BY segid ORDER BY a DESC, y, x) AS k, sqrt(count(*) OVER (PARTITION BY segid) / 3.0) AS radius FROM foot) WHERE k = 1)"""
LABELS = """lp AS (
  SELECT label AS t, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, avg(CAST(embedding[i] AS DOUBLE)) AS v
  FROM embeddings, range(1, 65) r(i) GROUP BY ALL
), ltops AS (SELECT t, max(v) AS top FROM lp GROUP BY t), lfoot AS (SELECT t AS segid, y, x, v / top AS a FROM lp JOIN ltops USING (t) WHERE v > 0 AND top > 0),
lcells AS (SELECT segid, y, x, radius FROM (
  SELECT segid, y, x, row_number() OVER (PARTITION BY segid ORDER BY a DESC, y, x) AS k, sqrt(count(*) OVER (PARTITION BY segid) / 3.0) AS radius FROM lfoot) WHERE k = 1)"""
_ASPECT = """SELECT segid, (cyy + cxx) / 2 AS half, sqrt(pow((cyy - cxx) / 2, 2) + cxy * cxy) AS spread FROM (
  SELECT segid, sum(a * y * y) / sum(a) - pow(sum(a * y) / sum(a), 2) AS cyy, sum(a * x * x) / sum(a) - pow(sum(a * x) / sum(a), 2) AS cxx,
         sum(a * y * x) / sum(a) - sum(a * y) / sum(a) * sum(a * x) / sum(a) AS cxy FROM foot GROUP BY segid)"""

QUERIES = {f.__name__: f for f in (
    segment_mask, rescale_segments, make_footprints, dense_footprints, footprint_boxes, boxed_footprints, boxed_overlap, boxed_tiles, footprint_area, footprint_aspect, base_threshold, footprint_centres, nearest_neighbor,
    max_overlap, tiles, tile_assign, clip_unclip, active_cells, clean_footprints, mutual_duplicates,
)}
ORACLES = {
    "segment_mask": f"WITH RECURSIVE {_GROWN} SELECT CAST(segid AS INTEGER) AS segid, y, x FROM grown",
    "rescale_segments": f"WITH RECURSIVE {_GROWN} SELECT CAST(segid AS INTEGER) AS segid, y, x, {r('(v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0)')} AS a FROM grown WINDOW w AS (PARTITION BY segid)",
    "make_footprints": f"""WITH RECURSIVE {_GROWN},
      scaled AS (SELECT l.segid AS t, l.y, l.x, CASE WHEN g.v IS NULL THEN 0 ELSE coalesce((g.v - min(g.v) OVER w) / nullif(max(g.v) OVER w - min(g.v) OVER w, 0), 0) END AS v FROM plog l LEFT JOIN grown g USING (segid, y, x) WINDOW w AS (PARTITION BY l.segid)),
      {closing_sql('scaled')} SELECT CAST(t AS INTEGER) AS segid, y, x, {r('v')} AS a FROM c4 WHERE round(v, 6) > 0""",
    "dense_footprints": f"WITH {LABELS} SELECT segid, 64 AS n, {r('sum(a)')} AS total FROM lfoot GROUP BY segid",
    "footprint_area": f"WITH {POSITIVE} SELECT segid, {r('sum(a)')} AS asum, count(*) AS area FROM foot GROUP BY segid",
    "footprint_aspect": f"WITH {POSITIVE} SELECT segid, {r('CASE WHEN half - spread > 1e-9 THEN sqrt((half + spread) / (half - spread)) END', 4)} AS aratio FROM ({_ASPECT})",
    "base_threshold": f"WITH {POSITIVE} SELECT segid, y, x, {r('(a - 0.3) / 0.7')} AS a FROM foot WHERE a > 0.3",
    "footprint_centres": f"WITH {CENTRES} SELECT segid, y, x, {r('radius')} AS radius FROM centres",
    "nearest_neighbor": f"WITH {LABELS} SELECT segid, o AS min_dist_id, {r('dist')} AS min_dist FROM (SELECT a.segid, b.segid AS o, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / a.radius AS dist, row_number() OVER (PARTITION BY a.segid ORDER BY sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / a.radius, b.segid) AS k FROM lcells a JOIN lcells b ON a.segid <> b.segid) WHERE k = 1",
    "max_overlap": f"WITH {LABELS} SELECT segid, o AS max_dup_id, {r('a')} AS max_dup FROM (SELECT c.segid, f.segid AS o, f.a, row_number() OVER (PARTITION BY c.segid ORDER BY f.a DESC, f.segid) AS k FROM lcells c JOIN lfoot f ON c.y = f.y AND c.x = f.x AND c.segid <> f.segid) WHERE k = 1",
    "mutual_duplicates": f"WITH {LABELS}, hits AS (SELECT c.segid AS i, f.segid AS j FROM lcells c JOIN lfoot f ON c.y = f.y AND c.x = f.x AND c.segid <> f.segid AND f.a > 0.2) SELECT a.i, a.j FROM hits a JOIN hits b ON a.i = b.j AND a.j = b.i",
    "tiles": f"WITH {CENTRES}, {TILES_SQL} SELECT tile, y0, y1, x0, x1, margin, count(segid) AS n FROM tiles LEFT JOIN centres ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL",
    "tile_assign": f"WITH {PIXELS}, {TILES_SQL} SELECT tile, count(*) AS n, {r('sum(v)')} AS total FROM pixels JOIN tiles ON y >= y0 - margin AND y < y1 + margin AND x >= x0 - margin AND x < x1 + margin GROUP BY tile",
    "clip_unclip": f"WITH {PIXELS} SELECT t, y, x, CASE WHEN y >= {TILES[3][1] - 1} AND x >= {TILES[3][3] - 1} THEN {r('v')} ELSE 0.0 END AS v FROM pixels",
    "active_cells": f"WITH {CENTRES}, {TILES_SQL} SELECT DISTINCT tile, f.segid, c.y >= y0 AND c.y < y1 AND c.x >= x0 AND c.x < x1 AS active FROM foot f JOIN tiles ON f.y >= y0 - margin AND f.y < y1 + margin AND f.x >= x0 - margin AND f.x < x1 + margin JOIN centres c ON c.segid = f.segid",
}
_BOX = f"WITH {POSITIVE} SELECT segid, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, sum(a) AS s FROM foot WHERE a > 0 GROUP BY segid"
ORACLES |= {
    "footprint_boxes": f"SELECT segid, CAST(y0 AS INTEGER) AS y0, CAST(y1 AS INTEGER) AS y1, CAST(x0 AS INTEGER) AS x0, CAST(x1 AS INTEGER) AS x1, CAST((y1 - y0) * (x1 - x0) AS INTEGER) AS n, {r('s')} AS total FROM ({_BOX})",
    "boxed_footprints": f"WITH {POSITIVE} SELECT segid, y, x, {r('a')} AS a FROM foot WHERE a > 0",
    "boxed_overlap": ORACLES["max_overlap"].replace("c.segid <> f.segid", "c.segid <> f.segid AND f.a > 0"),
    "boxed_tiles": ORACLES["active_cells"],
}
