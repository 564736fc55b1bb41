"""Queries on matrix products, objective, penalties and descent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import algebra as A
from ..operators import models as V
from ..operators import normalize as N
from ..sources import movies as M
from ..sources.store import materialise
from .cells import TRACES, traces
from .movie import CENTRED, SIDE, frames, r
from .segment import LABELS, label_footprints

PLACES = SIDE * SIDE
ETA, FAC = 0.5, 40.0
STEP_ETA, STEP_FAC = 1e-3, 50.0


def gram_matrix(spark, d):
    return A.gram(label_footprints(spark, d), PLACES).select("i", "j", tidy("ycov").alias("ycov"), tidy("yout").alias("yout"))


def unit_frames(spark, d):
    m = materialise(N.pixel_moments(frames(spark, d), SIDE, SIDE), "moments")
    return N.normalized(frames(spark, d), m, N.scalar_stats(m), SIDE, SIDE)


def dots(spark, d, footprints):
    """(segid, t, v): centred footprints times every frame, in the scan's tasks."""
    whole = [(0, 0, SIDE, 0, SIDE, 0)]
    found = V.tile_dots(unit_frames(spark, d), footprints.withColumn("tile", F.lit(0)), whole, SIDE, SIDE)
    return found.select(F.col("k").cast("int").alias("segid"), "t", "v")


def data_dot(spark, d):
    out = dots(spark, d, materialise(label_footprints(spark, d), "label-footprints"))
    return out.select("segid", "t", tidy("v", 5).alias("v"))


def first_traces(spark, d, footprints=None):
    """Starting traces: each label's mean footprint weighs the frames of the movie, positive part."""
    p = footprints if footprints is not None else label_footprints(spark, d)
    raw = p.join(M.pixels(frames(spark, d)), ["y", "x"]).groupBy("segid", "t").agg(F.greatest(F.sum(F.col("a") * F.col("v")), F.lit(0.0)).alias("v"))
    return raw


def _problem(spark, d):
    """Footprints, starting traces, Gram matrix, data product and V of the objective, as stage files."""
    # all are read several times, and small beside the movie
    p = materialise(label_footprints(spark, d), "label-footprints")
    x = materialise(first_traces(spark, d, p).withColumnRenamed("segid", "k"), "first-traces")
    pairs = materialise(A.gram(p, PLACES), "gram")
    nx = frames(spark, d).count()
    dot = materialise(dots(spark, d, p).withColumnRenamed("segid", "k"), "dots")
    return x, pairs, dot, nx, A.variance(pairs.select("i", "j", "ycov"), pairs.select("i", "j", "yout"), dot, x, nx, PLACES, 0.1, 0.1)


def loss_value(spark, d):
    out = _problem(spark, d)[-1]
    return out.select(tidy("v", 3).alias("v"), tidy("loss", 2).alias("loss"), tidy("sigma").alias("sigma"))


def _prox(kind):
    def query(spark, d):
        return traces(spark, d).withColumn("v", tidy(A.prox(kind, F.col("v"), ETA, FAC))).select("id", "t", "v")

    return query


def penalty_value(spark, d):
    rows, out = traces(spark, d), None
    for kind in ("l1", "l2", "nonneg_l1", "maxnorm"):
        one = A.penalty(kind, rows, 0.01).select(F.lit(kind).alias("kind"), tidy("value", 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def nesterov_step(spark, d):
    """One accelerated proximal step of the objective from the starting traces."""
    x, pairs, dot, nx, value = _problem(spark, d)
    out = A.step(pairs, dot, x, materialise(value, "value"), nx, PLACES, 0.1, 0.1, STEP_ETA, STEP_FAC, 1)
    return out.select("k", "t", tidy("new", 5).alias("new"), tidy("z", 5).alias("z"))


def reconstruct(spark, d):
    return A.reconstruct(label_footprints(spark, d), first_traces(spark, d)).select("t", "y", "x", tidy("v").alias("v"))


def background_weight(spark, d):
    """The signed penalty's weight of each trace."""
    return traces(spark, d).groupBy("id").agg(tidy(F.sum(F.abs(1e-4 * F.col("v")))).alias("weight"))


UNIT = CENTRED + ", px AS (SELECT t, y, x, (d - avgx) / std0 AS v FROM centred JOIN moments USING (y, x), unit)"
GRAM = f"""lmeans AS (SELECT segid, sum(a) / {PLACES} AS m FROM lfoot GROUP BY segid), raws AS (
  SELECT a.segid AS i, b.segid AS j, sum(a.a * b.a) AS raw FROM lfoot a JOIN lfoot b USING (y, x) GROUP BY 1, 2
), gram AS (SELECT a.segid AS i, b.segid AS j, coalesce(raw, 0) - {PLACES} * a.m * b.m AS ycov, a.m * b.m AS yout FROM lmeans a CROSS JOIN lmeans b LEFT JOIN raws ON i = a.segid AND j = b.segid)"""
DOT = """dots AS (SELECT segid AS k, t, sum(a * v) - any_value(m) * any_value(s) AS v FROM lfoot JOIN px USING (y, x) JOIN lmeans USING (segid) JOIN (SELECT t, sum(v) AS s FROM px GROUP BY t) USING (t) GROUP BY 1, 2)"""
START = "start AS (SELECT segid AS k, t, greatest(sum(a * v), 0.0) AS v FROM lfoot JOIN pixels USING (y, x) GROUP BY 1, 2)"
_PROX = {
    "l1": f"sign(v) * greatest(abs(v) - {ETA * FAC}, 0.0)", "l2": f"v / {1 + ETA * FAC}", "nonneg_l2": f"greatest(v, 0.0) / {1 + ETA * FAC}", "nonneg": f"greatest(v - {ETA * FAC}, 0.0)",
    "maxnorm": f"greatest(CASE WHEN greatest(v, 0.0) = top THEN greatest(v, 0.0) ELSE greatest(v, 0.0) - {ETA * FAC} / nullif(top, 0) END, 0.0)",
}
_KIND = {"l1": "l1", "l2": "l2", "nonneg_l2": "nonneg_l2", "nonneg": "nonneg_l1", "maxnorm": "maxnorm"}

QUERIES = {f.__name__: f for f in (gram_matrix, data_dot, loss_value, penalty_value, nesterov_step, reconstruct, background_weight)}
QUERIES |= {f"prox_{k}": _prox(v) for k, v in _KIND.items()}
ORACLES = {
    "gram_matrix": f"WITH {LABELS}, {GRAM} SELECT i, j, {r('ycov')} AS ycov, {r('yout')} AS yout FROM gram",
    "data_dot": f"WITH {UNIT}, {LABELS}, {GRAM}, {DOT} SELECT k AS segid, t, {r('v', 5)} AS v FROM dots",
    "loss_value": f"""WITH {UNIT}, {LABELS}, {GRAM}, {DOT}, {START}, n AS (SELECT count(DISTINCT t) * 1.0 AS nx FROM pixels),
      cen AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS c, avg(v) OVER (PARTITION BY k) AS m FROM start),
      xx AS (SELECT a.k AS i, b.k AS j, sum(a.c * b.c) AS xx FROM cen a JOIN cen b USING (t) GROUP BY 1, 2), ms AS (SELECT DISTINCT k, m FROM cen),
      parts AS (SELECT sum(ycov * xx) AS p1, sum(yout * xx) AS p2, sum(ycov * a.m * b.m) AS p3 FROM gram JOIN xx USING (i, j) JOIN ms a ON a.k = i JOIN ms b ON b.k = j),
      vv AS (SELECT p1 - 2 * (SELECT sum(dots.v * c) FROM dots JOIN cen USING (k, t)) + nx * {PLACES} + {PLACES} * 0.1 * p2 + nx * 0.1 * p3 AS v, nx * {PLACES} + nx + {PLACES} AS nm FROM parts, n)
      SELECT {r('v', 3)} AS v, {r('nm / 2 * (ln(v) - ln(nm))', 2)} AS loss, {r('sqrt(v / nm)')} AS sigma FROM vv""",
    "penalty_value": f"""WITH {TRACES} SELECT 'l1' AS kind, {r('sum(abs(0.01 * v))', 4)} AS value FROM traces UNION ALL SELECT 'l2', {r('sum(pow(0.01 * v, 2))', 4)} FROM traces
      UNION ALL SELECT 'nonneg_l1', {r('sum(0.01 * greatest(v, 0.0))', 4)} FROM traces UNION ALL SELECT 'maxnorm', {r('sum(q)', 4)} FROM (SELECT sum(0.01 * greatest(v, 0.0)) / nullif(max(greatest(v, 0.0)), 0) AS q FROM traces GROUP BY id)""",
    "nesterov_step": f"""WITH {UNIT}, {LABELS}, {GRAM}, {DOT}, {START}, n AS (SELECT count(DISTINCT t) * 1.0 AS nx FROM pixels),
      cen AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS c, avg(v) OVER (PARTITION BY k) AS m, v FROM start),
      xx AS (SELECT a.k AS i, b.k AS j, sum(a.c * b.c) AS xx FROM cen a JOIN cen b USING (t) GROUP BY 1, 2), ms AS (SELECT DISTINCT k, m FROM cen),
      parts AS (SELECT sum(ycov * xx) AS p1, sum(yout * xx) AS p2, sum(ycov * a.m * b.m) AS p3 FROM gram JOIN xx USING (i, j) JOIN ms a ON a.k = i JOIN ms b ON b.k = j),
      vv AS (SELECT p1 - 2 * (SELECT sum(dots.v * c) FROM dots JOIN cen USING (k, t)) + nx * {PLACES} + {PLACES} * 0.1 * p2 + nx * 0.1 * p3 AS v, nx * {PLACES} + nx + {PLACES} AS nm FROM parts, n),
      lin AS (SELECT i AS k, t, sum((ycov + {PLACES} * 0.1 * yout) * c) AS lin FROM gram JOIN cen ON k = j GROUP BY 1, 2),
      tied AS (SELECT i AS k, sum(ycov * m) AS tied FROM gram JOIN ms ON k = j GROUP BY 1),
      dd AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS dot FROM dots),
      y AS (SELECT k, t, cen.v, cen.v - {STEP_ETA!r} * nm / (2 * vv.v) * (2 * (lin - dot) + 0.2 * tied) AS y FROM cen JOIN lin USING (k, t) JOIN dd USING (k, t) JOIN tied USING (k), vv),
      s AS (SELECT *, greatest(y - {STEP_ETA * STEP_FAC!r}, 0.0) AS new FROM y)
      SELECT k, t, {r('new', 5)} AS new, {r('(1 - t1) * new + t1 * ((1 - t0) * v + t0 * new)', 5)} AS z FROM s, (SELECT 21 / 20.0::DOUBLE AS t0, 21 / 22.0::DOUBLE AS t1)""",
    "reconstruct": f"WITH {CENTRED}, {LABELS}, {START} SELECT s.t, y, x, {r('sum(a * s.v)')} AS v FROM lfoot f JOIN start s ON s.k = f.segid GROUP BY ALL",
    "background_weight": f"WITH {TRACES} SELECT id, {r('sum(abs(0.0001 * v))')} AS weight FROM traces GROUP BY id",
} | {f"prox_{k}": f"WITH {TRACES} SELECT id, t, {r(_PROX[k])} AS v FROM (SELECT *, max(greatest(v, 0.0)) OVER (PARTITION BY id) AS top FROM traces)" for k in _KIND}
