"""Queries on whole movies: statistics, normalisation, masks, stencils, peaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import normalize as N
from ..operators import peaks as P
from ..operators import stencils as S
from ..sources import movies as M
from ..sources.store import materialise

SIDE = M.SIDE
RADII = P.radii("logscale", 0.8, 1.8, 3)

PIXELS = """pixels AS (
  SELECT CAST(vec_id AS INTEGER) AS t, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
         CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) r(i)
)"""
CENTRED = PIXELS + """, centred AS (
  SELECT *, v - avg(v) OVER (PARTITION BY t) AS d FROM pixels
), shifted AS (
  SELECT c.t, c.y + dy.k AS y, c.x + dx.k AS x, c.d FROM centred c, range(-1, 2) dy(k), range(-1, 2) dx(k) WHERE dy.k <> 0 OR dx.k <> 0
), around AS (
  SELECT t, y, x, sum(d) / 8 AS n FROM shifted WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY ALL
), joined AS (
  SELECT c.*, a.n FROM centred c JOIN around a USING (t, y, x)
), moments AS (
  SELECT y, x, avg(d) AS avgx, var_pop(d) AS var, max(d) AS high, min(d) AS low, min(v) AS vmin, max(v) AS vmax,
         covar_pop(d, n) / nullif(sqrt(var_pop(d) * var_pop(n)), 0) AS icor
  FROM joined GROUP BY y, x
), unit AS (SELECT sqrt(avg(var)) AS std0 FROM moments)"""


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def kernel_sql(radius: float) -> str:
    """g and s: Gaussian weights and second-derivative weights at every offset."""
    n = 4 * int(np.ceil(radius))
    g = f"exp(-(d * d) / {2 * radius * radius!r}) / {radius * float(np.sqrt(2 * np.pi))!r}"
    return f"(SELECT CAST(d AS INTEGER) AS d, {g} AS g, (1 - (d * d) / {radius * radius!r}) * {g} AS s FROM range({-n}, {n + 1}) k(d))"


def log_sql(radius: float, ri: int, source: str = "pixels") -> str:
    k = kernel_sql(radius)
    return f"""SELECT t, {ri} AS ri, y, x, sum(a * w1 + b * w2) AS v FROM (
      SELECT p.t, p.y, CAST(p.x + k.d AS INTEGER) AS x, p.a * 1.0 AS a, p.b AS b, k.g AS w1, k.s AS w2
      FROM (SELECT t, CAST(p.y + k.d AS INTEGER) AS y, x, sum(v * k.s) AS a, sum(v * k.g) AS b
            FROM {source} p, {k} k WHERE p.y + k.d BETWEEN 0 AND 7 GROUP BY 1, 2, 3) p, {k} k
      WHERE p.x + k.d BETWEEN 0 AND 7) GROUP BY t, y, x"""


SCALES_SQL = PIXELS + ", scales AS (" + " UNION ALL ".join(log_sql(x, i) for i, x in enumerate(RADII)) + ")"
POOL_SQL = SCALES_SQL + """, pooled AS (
  SELECT t, ri, y, x, v, max(m2) OVER (PARTITION BY t, ri, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM (
    SELECT *, max(m1) OVER (PARTITION BY t, ri, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m2 FROM (
      SELECT *, max(v) OVER (PARTITION BY t, y, x ORDER BY ri ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1 FROM scales)))"""
RADIUS_SQL = "CAST(CASE ri " + " ".join(f"WHEN {i} THEN {x!r}" for i, x in enumerate(RADII)) + " END AS DOUBLE)"
BEST_SQL = POOL_SQL + f""", best AS (
  SELECT y, x, t, CAST(ri AS INTEGER) AS ri, {RADIUS_SQL} AS radius, v FROM (
    SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY v DESC, t, ri) AS k FROM pooled WHERE v = m) WHERE k = 1)"""


def frames(spark, d):
    return M.embedding_frames(spark, d)


def frame_mean(spark, d):
    return N.frame_means(frames(spark, d)).select("t", tidy("avgt").alias("avgt"))


def _moments(spark, d):
    """A row a pixel, as a stage file: the scalars and the normalised movie read it again."""
    return materialise(N.pixel_moments(frames(spark, d), SIDE, SIDE), "moments")


def pixel_stats(spark, d):
    m = _moments(spark, d)
    out = N.pixel_stats(m, N.scalar_stats(m))
    return out.select("y", "x", *[tidy(c).alias(c) for c in ("avgx", "imax", "imin", "istd", "icor")])


def neighbor_corr(spark, d):
    return _moments(spark, d).select("y", "x", tidy("icor").alias("icor"))


def scalar_stats(spark, d):
    s = N.scalar_stats(_moments(spark, d))
    return s.select(*[tidy(c).alias(c) for c in s.columns])


def masked_stats(spark, d):
    """The scalars of a movie with a region of interest: frame means and the unit go over the region."""
    f = frames(spark, d)
    mask = materialise(M.ring_mask(f), "mask")
    s = N.scalar_stats(materialise(N.pixel_moments(f, SIDE, SIDE, mask), "moments"), mask)
    return s.select(*[tidy(c).alias(c) for c in s.columns])


def masked_peaks(spark, d):
    """Each pixel's best peak inside a region of interest."""
    f = frames(spark, d)
    found = P.best_peaks(P.local_peaks(f, SIDE, SIDE, RADII, M.ring_mask(f)), RADII)
    return found.select("y", "x", "t", "ri", tidy("radius").alias("radius"), tidy("v").alias("v"))


def normalized_movie(spark, d):
    m = _moments(spark, d)
    out = N.normalized(frames(spark, d), m, N.scalar_stats(m), SIDE, SIDE)
    return M.pixels(out, SIDE).select("t", "y", "x", tidy("v").alias("v"))


def neighbor_mean(spark, d):
    return S.image_map(frames(spark, d), SIDE, SIDE, S.neighbor_mean).withColumn("v", tidy("v"))


def mask_crop(spark, d):
    f = frames(spark, d)
    return M.crop_to_mask(M.pixels(f), M.ring_mask(f)).withColumn("v", tidy("v"))


def pixel_series(spark, d):
    s = M.series(M.pixels(frames(spark, d)))
    return s.select("y", "x", "n", tidy("first").alias("first"), tidy("last").alias("last"))


def frame_choice(spark, d):
    f = frames(spark, d)
    wanted = N.frame_means(f).where("avgt > 0").select("t")
    return M.pixels(M.chosen_frames(f, wanted)).withColumn("v", tidy("v"))


def gaussian_blur(spark, d):
    return S.image_map(frames(spark, d), SIDE, SIDE, lambda i: S.gaussian(i, 1.0)).withColumn("v", tidy("v"))


def log_single(spark, d):
    return S.image_map(frames(spark, d), SIDE, SIDE, lambda i: S.log_filter(i, 1.0)).withColumn("v", tidy("v"))


def log_scales(spark, d):
    return S.scale_map(frames(spark, d), SIDE, SIDE, RADII, lambda s: s).withColumn("v", tidy("v"))


def max_pool3d(spark, d):
    return S.scale_map(frames(spark, d), SIDE, SIDE, RADII, S.max_pool).withColumn("v", tidy("v"))


def peak_test(spark, d):
    out = P.local_peaks(frames(spark, d), SIDE, SIDE, RADII)
    return out.select("t", "ri", "y", "x", tidy("v").alias("v"))


def _best(spark, d):
    return P.best_peaks(P.local_peaks(frames(spark, d), SIDE, SIDE, RADII), RADII)


def find_peaks(spark, d):
    return _best(spark, d).select("y", "x", "t", "ri", tidy("radius").alias("radius"), tidy("v").alias("v"))


def peaks_per_radius(spark, d):
    return _best(spark, d).groupBy(tidy("radius").alias("radius")).agg(F.count("*").alias("n"))


def grey_closing(spark, d):
    return S.image_map(frames(spark, d), SIDE, SIDE, lambda i: S.grey_closing(i, 4)).withColumn("v", tidy("v"))


def scale_table(spark, d):
    """Scales with the number of peaks that each has over all frames and pixels."""
    found = P.local_peaks(frames(spark, d), SIDE, SIDE, RADII).groupBy("ri").agg(F.count("*").alias("n"), tidy(F.max("v")).alias("top"))
    return found


def histogram_uniform(spark, d):
    """99 equal bins over [-0.1, 5] of all normalised pixels; values outside are not counted."""
    m = _moments(spark, d)
    values = M.pixels(N.normalized(frames(spark, d), m, N.scalar_stats(m), SIDE, SIDE), SIDE)
    place = F.floor((F.col("v") + 0.1) / (5.1 / 99))
    inside = values.where("v >= -0.1 and v <= 5").select(F.least(place, F.lit(98)).cast("int").alias("bin"))
    return inside.groupBy("bin").agg(F.count("*").alias("n"))


def nms_peaks(spark, d):
    out = P.reduce_peaks(_best(spark, d), 0.5, 1.5, 2.0)
    return out.select("segid", "kind", "y", "x", "t", tidy("radius").alias("radius"), tidy("firmness").alias("firmness"))


def nms_peaks_by_kind(spark, d):
    out = P.reduce_peaks(_best(spark, d), 0.5, 1.5, 2.0, block=1)
    return out.groupBy("kind").agg(F.count("*").alias("n"), tidy(F.max("firmness")).alias("top"))


def simple_peaks(spark, d):
    """Places of each blurred frame that equal the largest of their 3 x 3 surroundings."""
    from ..operators.stencils import by_frame

    def work(t, images):
        blurred = S.gaussian(images, 1.0)
        n, y, x = np.nonzero(blurred == S.max_pool(blurred, (-2, -1)))
        return {"t": t[n].astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": blurred[n, y, x]}

    return by_frame(frames(spark, d), SIDE, SIDE, work, "t int, y int, x int, v double").withColumn("v", tidy("v"))


def image_folds(spark, d):
    """Least, largest, sum and the first frame of the largest value at each pixel."""
    px = M.pixels(frames(spark, d))
    top = F.max(F.struct("v", (-F.col("t")).alias("t")))
    folded = px.groupBy("y", "x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"), top.alias("top"))
    return folded.select("y", "x", tidy("low").alias("low"), tidy("high").alias("high"), tidy("total").alias("total"), (-F.col("top.t")).alias("at"))


def positive_peaks(spark, d):
    """Peaks in scale space with a positive response, off the frame's edge and the outer scales."""
    inner = F.col("y").between(1, SIDE - 2) & F.col("x").between(1, SIDE - 2) & F.col("ri").between(1, len(RADII) - 2)
    return P.local_peaks(frames(spark, d), SIDE, SIDE, RADII).where(inner & (F.col("v") > 0)).select("t", "ri", "y", "x", tidy("v").alias("v"))


def mask_fill(spark, d):
    """The movie with zeros outside the mask."""
    f = frames(spark, d)
    mask = M.ring_mask(f).withColumn("inside", F.lit(True))
    return M.pixels(f).join(mask, ["y", "x"], "left").select("t", "y", "x", tidy(F.when(F.col("inside"), F.col("v")).otherwise(0.0)).alias("v"))


def _dilate(v: str, part: str, axis: str, a: int, b: int, fn: str, source: str, out: str) -> str:
    return f"{out} AS (SELECT t, y, x, {fn}({v}) OVER (PARTITION BY t, {part} ORDER BY {axis} ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS v FROM {source})"


def closing_sql(source: str) -> str:
    """CTEs c1..c4 over ``source`` (t, y, x, v): closing of size 4."""
    return ", ".join([
        _dilate("v", "x", "y", 1, 2, "max", source, "c1"), _dilate("v", "y", "x", 1, 2, "max", "c1", "c2"),
        _dilate("v", "x", "y", 2, 1, "min", "c2", "c3"), _dilate("v", "y", "x", 2, 1, "min", "c3", "c4"),
    ])


_BLURRED = f"""SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, sum(v * g) AS v FROM (
  SELECT p.t, p.y, p.x + k.d AS x, p.v, k.g FROM (
    SELECT t, p.y + k.d AS y, x, sum(v * k.g) AS v FROM pixels p, {kernel_sql(1.0)} k WHERE p.y + k.d BETWEEN 0 AND 7 GROUP BY 1, 2, 3) p,
  {kernel_sql(1.0)} k WHERE p.x + k.d BETWEEN 0 AND 7) GROUP BY t, y, x"""
_BLUR = f"SELECT t, y, x, {r('v')} AS v FROM ({_BLURRED})"

QUERIES = {f.__name__: f for f in (
    frame_mean, pixel_stats, neighbor_corr, scalar_stats, normalized_movie, neighbor_mean, mask_crop, pixel_series, frame_choice, gaussian_blur, log_single,
    log_scales, max_pool3d, peak_test, find_peaks, peaks_per_radius, grey_closing, scale_table, histogram_uniform, nms_peaks, nms_peaks_by_kind,
    simple_peaks, image_folds, positive_peaks, mask_fill, masked_stats, masked_peaks,
)}
MASK_SQL = """means AS (SELECT y, x, avg(v) AS m FROM pixels WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY y, x
), mask AS (SELECT y, x FROM means WHERE m > (SELECT avg(m) FROM means))"""
#: Greedy suppression by one recursion a candidate: the numbers of those accepted so far are carried along.
NMS_SQL = f"""RECURSIVE {BEST_SQL}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY v DESC, y, x) AS k, radius > 1.5 AS ground FROM best WHERE radius >= 0.5), above AS (
  SELECT b.k, list(a.k) AS ks FROM ranked a JOIN ranked b ON a.k < b.k AND (
    (NOT a.ground AND sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / a.radius <= 2.0)
    OR (a.ground = b.ground AND sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / b.radius < 2.0)) GROUP BY b.k), visit(k, held) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT v.k + 1, CASE WHEN list_has_any(v.held, coalesce(above.ks, CAST([] AS BIGINT[]))) THEN v.held ELSE list_append(v.held, v.k + 1) END
  FROM visit v LEFT JOIN above ON above.k = v.k + 1 WHERE v.k < (SELECT count(*) FROM ranked)), nms AS (
  SELECT CASE WHEN ground THEN 'background' ELSE 'cell' END AS kind, y, x, t, radius, v AS firmness FROM ranked
  WHERE list_contains((SELECT held FROM visit ORDER BY k DESC LIMIT 1), k))"""

ORACLES = {
    "nms_peaks": f"WITH {NMS_SQL} SELECT CAST(row_number() OVER (ORDER BY CASE kind WHEN 'cell' THEN 0 ELSE 1 END, firmness DESC, y, x) - 1 AS INTEGER) AS segid, kind, y, x, t, {r('radius')} AS radius, {r('firmness')} AS firmness FROM nms",
    "nms_peaks_by_kind": f"WITH {NMS_SQL} SELECT kind, count(*) AS n, {r('max(firmness)')} AS top FROM nms GROUP BY kind",
    "frame_mean": f"WITH {PIXELS} SELECT t, {r('avg(v)')} AS avgt FROM pixels GROUP BY t",
    "pixel_stats": f"WITH {CENTRED} SELECT y, x, {r('avgx')} AS avgx, {r('(high - avgx) / std0')} AS imax, {r('(low - avgx) / std0')} AS imin, {r('sqrt(var) / std0')} AS istd, {r('icor')} AS icor FROM moments, unit",
    "neighbor_corr": f"WITH {CENTRED} SELECT y, x, {r('icor')} AS icor FROM moments",
    "scalar_stats": f"WITH {CENTRED} SELECT {r('min(std0)')} AS std0, {r('min(vmin)')} AS min0, {r('max(vmax)')} AS max0, {r('min((low - avgx) / std0)')} AS min1, {r('max((high - avgx) / std0)')} AS max1 FROM moments, unit",
    "normalized_movie": f"WITH {CENTRED} SELECT t, y, x, {r('(d - avgx) / std0')} AS v FROM centred JOIN moments USING (y, x), unit",
    "neighbor_mean": f"WITH {PIXELS} SELECT t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r('sum(v) / 8')} AS v FROM (SELECT p.t, p.y + dy.k AS y, p.x + dx.k AS x, p.v FROM pixels p, range(-1, 2) dy(k), range(-1, 2) dx(k) WHERE dy.k <> 0 OR dx.k <> 0) WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY t, y, x",
    "mask_crop": f"WITH {PIXELS}, means AS (SELECT y, x, avg(v) AS m FROM pixels WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY y, x), mask AS (SELECT y, x FROM means WHERE m > (SELECT avg(m) FROM means)) SELECT t, y - (SELECT min(y) FROM mask) AS y, x - (SELECT min(x) FROM mask) AS x, {r('v')} AS v FROM pixels SEMI JOIN mask USING (y, x)",
    "simple_peaks": f"WITH {PIXELS}, blurred AS ({_BLURRED}) SELECT t, y, x, {r('v')} AS v FROM (SELECT *, max(m1) OVER (PARTITION BY t, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM (SELECT *, max(v) OVER (PARTITION BY t, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1 FROM blurred)) WHERE v = m",
    "image_folds": f"WITH {PIXELS} SELECT y, x, {r('min(v)')} AS low, {r('max(v)')} AS high, {r('sum(v)')} AS total, (array_agg(t ORDER BY v DESC, t))[1] AS at FROM pixels GROUP BY y, x",
    "positive_peaks": f"WITH {POOL_SQL} SELECT t, CAST(ri AS INTEGER) AS ri, y, x, {r('v')} AS v FROM pooled WHERE v = m AND v > 0 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND ri BETWEEN 1 AND {len(RADII) - 2}",
    "masked_stats": f"""WITH {PIXELS}, {MASK_SQL}, levels AS (SELECT t, avg(v) AS level FROM pixels SEMI JOIN mask USING (y, x) GROUP BY t),
      moments AS (SELECT y, x, avg(v - level) AS avgx, var_pop(v - level) AS var, max(v - level) AS high, min(v - level) AS low, min(v) AS vmin, max(v) AS vmax FROM pixels JOIN levels USING (t) GROUP BY y, x),
      unit AS (SELECT sqrt(avg(var)) AS std0 FROM moments SEMI JOIN mask USING (y, x))
      SELECT {r('min(std0)')} AS std0, {r('min(vmin)')} AS min0, {r('max(vmax)')} AS max0, {r('min((low - avgx) / std0)')} AS min1, {r('max((high - avgx) / std0)')} AS max1 FROM moments, unit""",
    "masked_peaks": f"WITH {BEST_SQL}, {MASK_SQL} SELECT y, x, t, ri, {r('radius')} AS radius, {r('v')} AS v FROM best SEMI JOIN mask USING (y, x)",
    "mask_fill": f"WITH {PIXELS}, means AS (SELECT y, x, avg(v) AS m FROM pixels WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY y, x), mask AS (SELECT y, x FROM means WHERE m > (SELECT avg(m) FROM means)) SELECT t, p.y, p.x, {r('CASE WHEN m.y IS NULL THEN 0 ELSE v END')} AS v FROM pixels p LEFT JOIN mask m ON p.y = m.y AND p.x = m.x",
    "pixel_series": f"WITH {PIXELS} SELECT y, x, count(*) AS n, {r('arg_min(v, t)')} AS first, {r('arg_max(v, t)')} AS last FROM pixels GROUP BY y, x",
    "frame_choice": f"WITH {PIXELS} SELECT t, y, x, {r('v')} AS v FROM pixels WHERE t IN (SELECT t FROM pixels GROUP BY t HAVING avg(v) > 0)",
    "gaussian_blur": f"WITH {PIXELS} {_BLUR}",
    "log_single": f"WITH {PIXELS} SELECT t, y, x, {r('v')} AS v FROM ({log_sql(1.0, 0)})",
    "log_scales": f"WITH {SCALES_SQL} SELECT t, CAST(ri AS INTEGER) AS ri, y, x, {r('v')} AS v FROM scales",
    "max_pool3d": f"WITH {POOL_SQL} SELECT t, CAST(ri AS INTEGER) AS ri, y, x, {r('m')} AS v FROM pooled",
    "peak_test": f"WITH {POOL_SQL} SELECT t, CAST(ri AS INTEGER) AS ri, y, x, {r('v')} AS v FROM pooled WHERE v = m",
    "find_peaks": f"WITH {BEST_SQL} SELECT y, x, t, ri, {r('radius')} AS radius, {r('v')} AS v FROM best",
    "peaks_per_radius": f"WITH {BEST_SQL} SELECT {r('radius')} AS radius, count(*) AS n FROM best GROUP BY 1",
    "grey_closing": f"WITH {PIXELS}, {closing_sql('pixels')} SELECT t, y, x, {r('v')} AS v FROM c4",
    "scale_table": f"WITH {POOL_SQL} SELECT CAST(ri AS INTEGER) AS ri, count(*) AS n, {r('max(v)')} AS top FROM pooled WHERE v = m GROUP BY 1",
    "histogram_uniform": f"WITH {CENTRED} SELECT CAST(least(floor((v + 0.1) / (5.1 / 99)), 98) AS INTEGER) AS bin, count(*) AS n FROM (SELECT (d - avgx) / std0 AS v FROM centred JOIN moments USING (y, x), unit) WHERE v >= -0.1 AND v <= 5 GROUP BY 1",
}
