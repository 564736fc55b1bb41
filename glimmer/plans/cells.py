"""Queries on traces, cell statistics and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import over, tidy
from ..operators import classify as C
from ..operators import traces as T
from ..sources import movies as M
from ..sources.store import materialise
from .movie import r

SIZE, FAST, SLOW, SCALE = T.double_exp()
FRAMES = M.HOURS - SIZE + 1
EDGES = [-3.0, -1.0, 0.0, 0.5, 1.0, 2.0, 5.0]
FIRM_EDGES = [0.0, 0.05, 0.1, 0.2, 0.4, 1.0]


def spikes(spark, d):
    return M.event_spikes(spark, d)


def double_exp_kernel(spark, d):
    """A response for every kind of event, over a second at 20 Hz: it decays the slower the larger the
    kind's mean value (500 give a second), and rises twice as fast."""
    mean = M.table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 500).alias("tau2"))
    settings = mean.select("event_type", (F.col("tau2") / 2).alias("tau1"), "tau2", F.lit(1.0).alias("duration"), F.lit(20.0).alias("hz"))
    return T.kernels(settings, "event_type").select("event_type", "j", tidy("w").alias("w"))


def spike_to_calcium(spark, d):
    out = T.spike_to_calcium(spikes(spark, d), T.kernel(spark), SIZE, FRAMES)
    return out.select("spkid", "t", tidy("v").alias("v"))


def traces(spark, d):
    return M.supplier_months(spark, d)


def calcium_to_spike(spark, d):
    return T.calcium_to_spike(traces(spark, d)).select("id", "u", tidy("v", 3).alias("v"))


def spike_stats(spark, d):
    s = T.spike_stats(spikes(spark, d), M.HOURS)
    return s.select("spkid", tidy("signal").alias("signal"), tidy("udense").alias("udense"), "unz")


def signal_noise(spark, d):
    s = T.spike_stats(spikes(spark, d), M.HOURS)
    return s.select("spkid", tidy("snratio").alias("snratio"), tidy("rsn").alias("rsn"))


def background_stats(spark, d):
    return T.background_stats(traces(spark, d)).select("id", tidy("bmax").alias("bmax"), tidy("bsparse").alias("bsparse"))


def cells(spark, d):
    """A statistics table by user: every fifth is a background; firmness is how peaked the values are."""
    e = M.table(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("segid")).agg(
        (F.avg("value") / F.max("value")).alias("firmness"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean")
    )
    s = T.spike_stats(spikes(spark, d), M.HOURS).withColumnRenamed("spkid", "segid")
    named = e.join(s, "segid", "left").withColumn("kind", F.when(F.col("segid") % 5 == 0, "background").otherwise("cell"))
    return named.withColumns({
        "y": (F.col("segid") / 16).cast("int"), "x": (F.col("segid") % 16).cast("int"),
        "radius": 2 + F.col("mean") / 40, "pos_move": F.col("least") / 2, "aratio": 1 + F.col("firmness") * 10,
    })


def kept_cells(spark, d):
    """The statistics table as a stage file: what follows reads it several times."""
    return materialise(cells(spark, d), "cells")


def live(spark, d, table=None):
    return (table if table is not None else kept_cells(spark, d)).where("kind = 'cell' and signal > 0")


def robust_zscore(spark, d):
    return T.robust_zscore(live(spark, d), zrsn="rsn").select("segid", tidy("zrsn").alias("zrsn"))


def mahalanobis(spark, d):
    return T.mahalanobis(live(spark, d), "firmness", "rsn", "mah").select("segid", tidy("mah").alias("mah"))


def _scored(spark, d, table=None):
    z = T.robust_zscore(live(spark, d, table), zrsn="rsn", zfirm="firmness")
    return T.mahalanobis(z.withColumn("hypot", F.hypot("zfirm", "zrsn")), "firmness", "rsn", "mah")


def hypot_score(spark, d):
    return _scored(spark, d).select("segid", tidy("hypot").alias("hypot"))


def histogram_fixed(spark, d):
    z = T.robust_zscore(live(spark, d), zrsn="rsn").select(T.in_bins(F.col("zrsn"), EDGES).alias("bin"))
    return z.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def robust_report(spark, d):
    """Median plus two scaled deviations of the metrics."""
    levels = T.robust_levels(live(spark, d), "firmness", "rsn")
    return levels.select("metric", tidy(F.col("mid") + 2 * F.col("spread")).alias("level"))


def evaluate_kind(spark, d):
    return C.silent_to_remove(cells(spark, d)).select("segid", "kind", "old_kind", "spkid", "bgid")


def _metrics(spark, d):
    own = kept_cells(spark, d)
    s = _scored(spark, d, own).select("segid", "zrsn", "hypot", "mah")
    b = T.background_stats(spikes(spark, d).select(F.col("spkid").alias("id"), "v")).withColumnRenamed("id", "segid")
    return own.join(s, "segid", "left").join(b, "segid", "left")


def fix_kind(spark, d):
    out = C.fix_kind(_metrics(spark, d), {"zrsn": 1.0, "mah": 2.0, "udense": 0.004}, {"bmax": 150.0, "bsparse": 2.0})
    return C.renumber(out).select("segid", "kind", "old_kind", "spkid", "bgid")


def clean_rules(spark, d):
    out = C.clean(_metrics(spark, d), 0.25, 3.0, {"aratio": 2.6, "mah": 2.0}, {"bmax": 150.0})
    return out.select("segid", "kind", "old_kind")


def sort_segid(spark, d):
    """Cells, then backgrounds, numbered by falling firmness."""
    from ..operators.peaks import with_segid

    c = cells(spark, d).select("kind", "y", "x", F.col("segid").alias("t"), "radius", "firmness")
    return with_segid(c).select("segid", "kind", "t", tidy("firmness").alias("firmness"))


def histogram_firmness(spark, d):
    """Cells by bins of firmness; half-open, the last closed."""
    z = live(spark, d).select(T.in_bins(F.col("firmness"), FIRM_EDGES).alias("bin"))
    return z.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def report_order(spark, d):
    """The order of the reports: cells by falling signal, backgrounds by falling firmness, as ranks."""
    from pyspark.sql import Window

    c = cells(spark, d)
    key = F.when(F.col("kind") == "cell", F.coalesce("signal", F.lit(0.0))).otherwise(F.col("firmness"))
    return c.select("kind", "segid", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(key), "segid")).alias("place"))


def after_removal(spark, d):
    """Cells that the cleaning rules leave, as the next step reads them."""
    kept = kept_cells(spark, d)
    gone = C.silent_to_remove(kept).where("kind = 'remove'").select("segid")
    return kept.join(gone, "segid", "left_anti").select("segid", "kind", tidy("radius").alias("radius"))


def fix_top(spark, d):
    return T.damp_top(traces(spark, d)).select("id", "t", tidy("v").alias("v"))


def kind_union(spark, d):
    """Cells and backgrounds side by side with what applies to each."""
    c, b = live(spark, d), T.background_stats(traces(spark, d))
    left = c.select(F.lit("cell").alias("kind"), "segid", tidy("signal").alias("signal"))
    right = b.select(F.lit("background").alias("kind"), F.col("id").alias("segid"), tidy("bmax").alias("bmax"))
    return left.unionByName(right, allowMissingColumns=True)


def old_filters(spark, d):
    """Background predicates on single cells: linear score, noise and firmness limits, density limits."""
    c = live(spark, d)
    score = -2.0 + 1.5 * F.log10("snratio") + 4 * F.col("firmness") < 0
    noisy = (F.col("rsn") > 0.8) | (F.col("firmness") < 0.05)
    dense = (F.col("udense") > 0.01) | (F.col("signal") < 50) | (F.col("firmness") < 0.05)
    return c.select("segid", score.alias("linear"), noisy.alias("noisy"), dense.alias("dense"))


SPIKES = f"""spikes AS (
  SELECT * FROM (SELECT CAST(user_id AS INTEGER) AS spkid, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS INTEGER) AS u, sum(greatest(value - 100.0, 0.0)) AS v
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) WHERE v > 0 AND u >= 0
), sstats AS (
  SELECT spkid, signal, total / {M.HOURS} / nullif(signal, 0) AS udense, unz, signal / nullif(1.4826 * med, 0) AS snratio, 1 / nullif(signal / nullif(1.4826 * med, 0), 0) AS rsn
  FROM (SELECT spkid, max(v) AS signal, sum(v) AS total, count(*) AS unz, median(v) AS med FROM spikes GROUP BY spkid)
)"""
TRACES = """sums AS (
  SELECT CAST(l_suppkey AS INTEGER) AS id, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 12 * 1995 - 1 AS INTEGER) AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2
), filled AS (
  SELECT i.id, CAST(k.t AS INTEGER) AS t, coalesce(s.q, 0.0) AS q FROM (SELECT DISTINCT id FROM sums) i
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(t) FROM sums) + 1)) AS t) k LEFT JOIN sums s ON s.id = i.id AND s.t = k.t
), traces AS (SELECT id, t, q - avg(q) OVER (PARTITION BY id) AS v FROM filled)"""
CELLS = SPIKES + """, cells AS (
  SELECT e.*, s.signal, s.udense, s.unz, s.snratio, s.rsn, CASE WHEN e.segid % 5 = 0 THEN 'background' ELSE 'cell' END AS kind, e.segid // 16 AS y, e.segid % 16 AS x,
         2 + mean / 40 AS radius, least_v / 2 AS pos_move, 1 + firmness * 10 AS aratio
  FROM (SELECT CAST(user_id AS INTEGER) AS segid, avg(value) / max(value) AS firmness, min(value) AS least_v, avg(value) AS mean FROM events GROUP BY 1) e LEFT JOIN sstats s ON s.spkid = e.segid
), live AS (SELECT * FROM cells WHERE kind = 'cell' AND signal > 0
), mids AS (SELECT median(rsn) AS mr, median(firmness) AS mf FROM live
), devs AS (SELECT 1.4826 * median(abs(rsn - mr)) AS dr, 1.4826 * median(abs(firmness - mf)) AS df FROM live, mids
), cov AS (SELECT avg(firmness) AS mx, avg(rsn) AS my, var_pop(firmness) AS vx, var_pop(rsn) AS vy, covar_pop(firmness, rsn) AS c FROM live
), scored AS (
  SELECT live.*, (rsn - mr) / nullif(dr, 0) AS zrsn, sqrt(pow((firmness - mf) / nullif(df, 0), 2) + pow((rsn - mr) / nullif(dr, 0), 2)) AS hypot,
         sqrt((vy * pow(firmness - mx, 2) - 2 * c * (firmness - mx) * (rsn - my) + vx * pow(rsn - my, 2)) / nullif(vx * vy - c * c, 0)) AS mah
  FROM live, mids, devs, cov
), bstats AS (SELECT spkid, max(abs(v)) AS bmax, max(v) / nullif(1.4826 * median(abs(v)), 0) AS bsparse FROM spikes GROUP BY spkid
), metrics AS (SELECT c.*, s.zrsn, s.hypot, s.mah, b.bmax, b.bsparse FROM cells c LEFT JOIN scored s USING (segid) LEFT JOIN bstats b ON b.spkid = c.segid)"""
_EVAL = CELLS + ", fixed AS (SELECT segid, kind AS old_kind, CASE WHEN kind = 'cell' AND coalesce(signal, 0) = 0 THEN 'remove' ELSE kind END AS kind FROM cells)"
_FIX = CELLS + """, fixed AS (SELECT segid, kind AS old_kind, CASE
  WHEN kind = 'cell' AND (coalesce(zrsn > 1.0, false) OR coalesce(mah > 2.0, false) OR coalesce(udense < 0.004, false)) THEN 'background'
  WHEN kind = 'background' AND coalesce(bmax > 150.0, false) AND coalesce(bsparse > 2.0, false) THEN 'cell' ELSE kind END AS kind FROM metrics)"""
_NUMBERED = """SELECT segid, kind, old_kind, CAST(CASE WHEN kind = 'cell' THEN n ELSE -1 END AS INTEGER) AS spkid, CAST(CASE WHEN kind = 'background' THEN n ELSE -1 END AS INTEGER) AS bgid
  FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY kind <> old_kind, segid) - 1 AS n FROM fixed)"""
_KERNEL = f"(SELECT CAST(j AS INTEGER) AS j, (exp(-(j + 1) / {FAST!r}) - exp(-(j + 1) / {SLOW!r})) / {SCALE!r} AS w FROM range(0, {SIZE}) k(j))"


def _bins(edges):
    return "CASE " + " ".join(f"WHEN z >= {a} AND z {'<=' if i == len(edges) - 2 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))) + " END"


_BINS, _FIRM_BINS = _bins(EDGES), _bins(FIRM_EDGES)

QUERIES = {f.__name__: f for f in (
    double_exp_kernel, spike_to_calcium, calcium_to_spike, spike_stats, signal_noise, background_stats, robust_zscore, mahalanobis, hypot_score, histogram_fixed,
    robust_report, histogram_firmness, report_order, after_removal, evaluate_kind, fix_kind, clean_rules, sort_segid, fix_top, kind_union, old_filters,
)}
ORACLES = {
    "double_exp_kernel": f"""SELECT event_type, CAST(j AS INTEGER) AS j, {r('(exp(-(j + 1) / fast) - exp(-(j + 1) / slow)) / (pow(fast / slow, -slow / (fast - slow)) - pow(fast / slow, -fast / (fast - slow)))')} AS w
      FROM (SELECT event_type, avg(value) / 1000 * 20 AS fast, avg(value) / 500 * 20 AS slow FROM events GROUP BY event_type), range(0, 20) k(j) WHERE slow > 0""",
    "spike_to_calcium": f"WITH {SPIKES} SELECT spkid, t, {r('sum(v)')} AS v FROM (SELECT spkid, CAST(u - {SIZE - 1} + j AS INTEGER) AS t, v * w AS v FROM spikes, {_KERNEL}) WHERE t BETWEEN 0 AND {FRAMES - 1} GROUP BY 1, 2",
    "calcium_to_spike": f"""WITH {TRACES}, tail AS (SELECT id, t + {SIZE - 1} AS u, (v - (e1 + e2) * lag(v, 1) OVER w + e1 * e2 * lag(v, 2) OVER w) * {SCALE!r} / (e1 - e2) AS v
      FROM traces, (SELECT exp(-1 / {FAST!r}) AS e1, exp(-1 / {SLOW!r}) AS e2) WINDOW w AS (PARTITION BY id ORDER BY t)),
      every AS (SELECT id, u, v FROM tail WHERE v IS NOT NULL UNION ALL SELECT id, u, 0.0 FROM (SELECT DISTINCT id FROM traces), range(0, {SIZE + 1}) k(u))
      SELECT id, CAST(u AS INTEGER) AS u, {r('v + min(v) OVER (PARTITION BY id)', 3)} AS v FROM every""",
    "spike_stats": f"WITH {SPIKES} SELECT spkid, {r('signal')} AS signal, {r('udense')} AS udense, unz FROM sstats",
    "signal_noise": f"WITH {SPIKES} SELECT spkid, {r('snratio')} AS snratio, {r('rsn')} AS rsn FROM sstats",
    "background_stats": f"WITH {TRACES} SELECT id, {r('max(abs(v))')} AS bmax, {r('max(v) / nullif(1.4826 * median(CASE WHEN v <> 0 THEN abs(v) END), 0)')} AS bsparse FROM traces GROUP BY id",
    "robust_zscore": f"WITH {CELLS} SELECT segid, {r('zrsn')} AS zrsn FROM scored",
    "mahalanobis": f"WITH {CELLS} SELECT segid, {r('mah')} AS mah FROM scored",
    "hypot_score": f"WITH {CELLS} SELECT segid, {r('hypot')} AS hypot FROM scored",
    "histogram_fixed": f"WITH {CELLS} SELECT CAST({_BINS} AS INTEGER) AS bin, count(*) AS n FROM (SELECT zrsn AS z FROM scored) WHERE {_BINS} IS NOT NULL GROUP BY 1",
    "histogram_firmness": f"WITH {CELLS} SELECT CAST({_FIRM_BINS} AS INTEGER) AS bin, count(*) AS n FROM (SELECT firmness AS z FROM live) WHERE {_FIRM_BINS} IS NOT NULL GROUP BY 1",
    "report_order": f"WITH {CELLS} SELECT kind, segid, CAST(row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'cell' THEN coalesce(signal, 0) ELSE firmness END DESC, segid) AS INTEGER) AS place FROM cells",
    "after_removal": f"WITH {CELLS} SELECT segid, kind, {r('radius')} AS radius FROM cells WHERE NOT (kind = 'cell' AND coalesce(signal, 0) = 0)",
    "robust_report": f"WITH {CELLS} SELECT 'firmness' AS metric, {r('mf + 2 * df')} AS level FROM mids, devs UNION ALL SELECT 'rsn', {r('mr + 2 * dr')} FROM mids, devs",
    "evaluate_kind": f"""WITH {_EVAL} SELECT segid, kind, old_kind, CAST(CASE WHEN kind = 'cell' THEN n ELSE -1 END AS INTEGER) AS spkid, CAST(CASE WHEN kind = 'background' THEN n ELSE -1 END AS INTEGER) AS bgid
      FROM (SELECT *, row_number() OVER (PARTITION BY old_kind ORDER BY segid) - 1 AS n FROM fixed)""",
    "fix_kind": f"WITH {_FIX} {_NUMBERED}",
    "clean_rules": f"""WITH {CELLS} SELECT segid, CASE WHEN (kind = 'cell' AND coalesce(pos_move > 0.25, false)) OR coalesce(radius < 3.0, false) THEN 'remove'
      WHEN coalesce(aratio > 2.6, false) OR coalesce(mah > 2.0, false) OR (kind = 'background' AND NOT coalesce(bmax > 150.0, false)) THEN 'background' ELSE 'cell' END AS kind, kind AS old_kind FROM metrics""",
    "sort_segid": f"WITH {CELLS} SELECT CAST(row_number() OVER (ORDER BY CASE WHEN kind = 'cell' THEN 0 ELSE 1 END, firmness DESC, y, x) - 1 AS INTEGER) AS segid, kind, segid AS t, {r('firmness')} AS firmness FROM cells",
    "fix_top": f"WITH {TRACES} SELECT id, t, {r('CASE WHEN k = 1 THEN coalesce(nv, v) ELSE v END')} AS v FROM (SELECT *, row_number() OVER w AS k, lead(v) OVER w AS nv FROM traces WINDOW w AS (PARTITION BY id ORDER BY v DESC, t))",
    "kind_union": f"WITH {CELLS}, {TRACES} SELECT 'cell' AS kind, segid, {r('signal')} AS signal, NULL::DOUBLE AS bmax FROM live UNION ALL SELECT 'background', id, NULL, {r('max(abs(v))')} FROM traces GROUP BY id",
    "old_filters": f"WITH {CELLS} SELECT segid, -2.0 + 1.5 * log10(snratio) + 4 * firmness < 0 AS linear, rsn > 0.8 OR firmness < 0.05 AS noisy, udense > 0.01 OR signal < 50 OR firmness < 0.05 AS dense FROM live",
}
