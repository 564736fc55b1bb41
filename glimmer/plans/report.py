"""Queries behind figures and tables: images over cells, counts by group, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import over, tidy
from ..sources import movies as M
from ..sources.store import materialise
from .algebra import first_traces
from .cells import CELLS, SIZE, SPIKES, TRACES, cells, live, spikes, traces
from .movie import CENTRED, _best, _moments, frames, r
from .segment import LABELS, POSITIVE, centre_cells, label_footprints, positive


def seg_max_image(spark, d):
    """The largest stretched weight over all footprints at each pixel."""
    return positive(spark, d).groupBy("y", "x").agg(tidy(F.max(F.greatest(F.lit(0.0), (F.col("a") - 0.3) / 0.7))).alias("a"))


def bg_sum_image(spark, d):
    """Label footprints weighted by their trace's largest absolute value, over the image's maximum."""
    top = first_traces(spark, d).groupBy("segid").agg(F.max(F.abs("v")).alias("bmax"))
    image = label_footprints(spark, d).join(top, "segid").groupBy("y", "x").agg(F.sum(F.col("a") * F.col("bmax")).alias("v"))
    return image.crossJoin(F.broadcast(image.agg(F.max("v").alias("m")))).select("y", "x", tidy(over(F.col("v"), F.col("m"))).alias("v"))


def spike_image(spark, d):
    """Spikes over the row's maximum, without the places that only lead into the first frame."""
    s = spikes(spark, d)
    return s.where(F.col("u") >= SIZE - 1).join(s.groupBy("spkid").agg(F.max("v").alias("m")), "spkid").select("spkid", "u", tidy(F.col("v") / F.col("m")).alias("v"))


def segs_crops(spark, d):
    """A square of 5 x 5 around every centre, zero where the footprint is not."""
    c = centre_cells(spark, d).select("segid", F.col("y").alias("cy"), F.col("x").alias("cx"))
    side = F.sequence(F.lit(-2), F.lit(2))
    grid = c.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side)).withColumns({"y": F.col("cy") + F.col("dy"), "x": F.col("cx") + F.col("dx")})
    return grid.join(positive(spark, d), ["segid", "y", "x"], "left").select("segid", "dy", "dx", tidy(F.coalesce("a", F.lit(0.0))).alias("a"))


def cell_count_by_stage(spark, d):
    """Cells and backgrounds by week of the events, as stages."""
    e = M.table(spark, d, "events").select((F.floor((F.dayofmonth("ts") - 1) / 7)).cast("int").alias("stage"), "user_id").distinct()
    kind = cells(spark, d).select(F.col("segid").cast("long").alias("user_id"), "kind")
    return e.join(kind, "user_id").groupBy("stage", "kind").agg(F.count("*").alias("n"))


def dense_signal(spark, d):
    """Density against signal by kind, cells beyond the limit marked as backgrounds."""
    c = cells(spark, d).where("signal > 0")
    return c.select("segid", F.when(F.col("udense") > 0.01, "background").otherwise(F.col("kind")).alias("kind"), tidy("udense").alias("udense"), tidy("signal").alias("signal"))


def rule_colours(spark, d):
    """Which rule a cell meets first."""
    c = live(spark, d)
    colour = F.when(F.col("firmness") < 0.1, "firmness").when(F.col("udense") > 0.01, "udense").when(F.col("rsn") > 0.9, "rsn").otherwise("kept")
    return c.groupBy(colour.alias("colour")).agg(F.count("*").alias("n"))


def compare_penalties(spark, d):
    """Histograms of the traces after the signed penalty at several weights."""
    weights = spark.createDataFrame([(10.0,), (20.0,), (40.0,)], "fac double")
    shrunk = traces(spark, d).crossJoin(F.broadcast(weights)).withColumn("s", F.signum("v") * F.greatest(F.abs("v") - F.col("fac"), F.lit(0.0)))
    return shrunk.groupBy("fac", F.floor(F.col("s") / 50).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def peak_stats(spark, d):
    """Radius and firmness of the peaks of all pixels with how many share the radius."""
    b = _best(spark, d)
    count = b.groupBy("ri").agg(F.count("*").alias("n"))
    return b.join(count, "ri").select("y", "x", tidy("radius").alias("radius"), tidy("v").alias("firmness"), "n")


def image_summary(spark, d):
    """Per-pixel maximum, deviation and correlation brought to 0..1."""
    m = _moments(spark, d).select("y", "x", F.col("high").alias("imax"), F.sqrt("var").alias("istd"), "icor")
    ends = m.agg(*[f(c).alias(f"{n}_{c}") for c in ("imax", "istd", "icor") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    scaled = lambda c: tidy(over(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c)
    return m.crossJoin(F.broadcast(ends)).select("y", "x", scaled("imax"), scaled("istd"), scaled("icor"))


def calcium_plot(spark, d):
    """Traces over their footprint's sum, each lifted by its number."""
    size = label_footprints(spark, d).groupBy("segid").agg(F.sum("a").alias("s"))
    return first_traces(spark, d).join(size, "segid").select("segid", "t", tidy(F.col("v") / F.col("s") + F.col("segid")).alias("v"))


def close_pairs(spark, d):
    """Centres of label footprints nearer than three radii of the first, through a grid of that width."""
    from .segment import label_cells

    c = materialise(label_cells(spark, d), "label-cells")
    c = c.crossJoin(F.broadcast(c.agg((3 * F.max("radius")).alias("w"))))  # one row
    around = F.array(*[F.struct((F.floor(F.col("y") / F.col("w")) + a).alias("gy"), (F.floor(F.col("x") / F.col("w")) + b).alias("gx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = c.select(F.col("segid").alias("i"), "y", "x", "radius", F.explode(around).alias("g")).select("i", "y", "x", "radius", "g.gy", "g.gx")
    right = c.select(F.col("segid").alias("j"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.floor(F.col("y") / F.col("w")).alias("gy"), F.floor(F.col("x") / F.col("w")).alias("gx"))
    far = F.hypot(F.col("y") - F.col("oy"), F.col("x") - F.col("ox"))
    return left.join(right, ["gy", "gx"]).where("i <> j").where(far < 3 * F.col("radius")).select("i", "j", tidy(far).alias("distance"))


def kind_tables(spark, d):
    """Counts and signal ranges by kind."""
    return cells(spark, d).groupBy("kind").agg(F.count("*").alias("n"), tidy(F.min("signal")).alias("low"), tidy(F.max("signal")).alias("high"), F.count(F.when(F.col("signal").isNull(), 1)).alias("silent"))


def loss_log(spark, d):
    """A log by stage and division: the mean, and the best so far, of what each hour's events cost."""
    from pyspark.sql import Window

    e = M.table(spark, d, "events").groupBy(F.dayofmonth("ts").cast("int").alias("stage"), F.hour("ts").cast("int").alias("div")).agg(F.avg("value").alias("loss"))
    w = Window.partitionBy("stage").orderBy("div").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("stage", "div", tidy("loss").alias("loss"), tidy(F.min("loss").over(w)).alias("best"))


def sweep_counts(spark, d):
    """How many cells a grid of two limits keeps."""
    grid = spark.createDataFrame([(a, b) for a in (0.05, 0.1, 0.2) for b in (100.0, 200.0, 300.0)], "firm double, limit_low double")
    return live(spark, d).crossJoin(F.broadcast(grid)).groupBy("firm", "limit_low").agg(F.count(F.when((F.col("firmness") >= F.col("firm")) & (F.col("signal") >= F.col("limit_low")), 1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    seg_max_image, bg_sum_image, spike_image, segs_crops, cell_count_by_stage, dense_signal, rule_colours, compare_penalties, peak_stats, image_summary, calcium_plot,
    close_pairs, kind_tables, loss_log, sweep_counts,
)}


def _oracles() -> dict[str, str]:
    from .algebra import START
    from .movie import BEST_SQL
    from .segment import CENTRES

    return {
        "seg_max_image": f"WITH {POSITIVE} SELECT y, x, {r('max(greatest(0.0, (a - 0.3) / 0.7))')} AS a FROM foot GROUP BY y, x",
        "bg_sum_image": f"WITH {CENTRED}, {LABELS}, {START}, tops2 AS (SELECT k, max(abs(v)) AS bmax FROM start GROUP BY k), image AS (SELECT y, x, sum(a * bmax) AS v FROM lfoot JOIN tops2 ON k = segid GROUP BY y, x) SELECT y, x, {r('v / (SELECT max(v) FROM image)')} AS v FROM image",
        "spike_image": f"WITH {SPIKES} SELECT spkid, u, {r('v / m')} AS v FROM (SELECT *, max(v) OVER (PARTITION BY spkid) AS m FROM spikes) WHERE u >= {SIZE - 1}",
        "segs_crops": f"WITH {CENTRES} SELECT c.segid, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, {r('coalesce(a, 0.0)')} AS a FROM centres c, range(-2, 3) p(dy), range(-2, 3) q(dx) LEFT JOIN foot f ON f.segid = c.segid AND f.y = c.y + dy AND f.x = c.x + dx",
        "cell_count_by_stage": f"WITH {CELLS} SELECT CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS stage, kind, count(DISTINCT user_id) AS n FROM events JOIN cells ON segid = user_id GROUP BY 1, 2",
        "dense_signal": f"WITH {CELLS} SELECT segid, CASE WHEN udense > 0.01 THEN 'background' ELSE kind END AS kind, {r('udense')} AS udense, {r('signal')} AS signal FROM cells WHERE signal > 0",
        "rule_colours": f"WITH {CELLS} SELECT CASE WHEN firmness < 0.1 THEN 'firmness' WHEN udense > 0.01 THEN 'udense' WHEN rsn > 0.9 THEN 'rsn' ELSE 'kept' END AS colour, count(*) AS n FROM live GROUP BY 1",
        "compare_penalties": f"WITH {TRACES} SELECT fac, CAST(floor(sign(v) * greatest(abs(v) - fac, 0.0) / 50) AS INTEGER) AS bin, count(*) AS n FROM traces, (SELECT unnest([10.0, 20.0, 40.0]::DOUBLE[]) AS fac) GROUP BY 1, 2",
        "peak_stats": f"WITH {BEST_SQL} SELECT y, x, {r('radius')} AS radius, {r('v')} AS firmness, count(*) OVER (PARTITION BY ri) AS n FROM best",
        "image_summary": f"WITH {CENTRED}, im AS (SELECT y, x, high AS imax, sqrt(var) AS istd, icor FROM moments) SELECT y, x, " + ", ".join(f"{r(f'({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)')} AS {c}" for c in ("imax", "istd", "icor")) + " FROM im",
        "calcium_plot": f"WITH {CENTRED}, {LABELS}, {START}, sizes AS (SELECT segid, sum(a) AS s FROM lfoot GROUP BY segid) SELECT segid, t, {r('v / s + segid')} AS v FROM start JOIN sizes ON segid = k",
        "close_pairs": f"WITH {LABELS} SELECT a.segid AS i, b.segid AS j, {r('sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))')} AS distance FROM lcells a JOIN lcells b ON a.segid <> b.segid AND sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) < 3 * a.radius",
        "kind_tables": f"WITH {CELLS} SELECT kind, count(*) AS n, {r('min(signal)')} AS low, {r('max(signal)')} AS high, count(*) - count(signal) AS silent FROM cells GROUP BY kind",
        "loss_log": f"WITH e AS (SELECT CAST(day(ts) AS INTEGER) AS stage, CAST(hour(ts) AS INTEGER) AS div, avg(value) AS loss FROM events GROUP BY 1, 2) SELECT stage, div, {r('loss')} AS loss, {r('min(loss) OVER (PARTITION BY stage ORDER BY div)')} AS best FROM e",
        "sweep_counts": f"WITH {CELLS} SELECT firm, limit_low, count(CASE WHEN firmness >= firm AND signal >= limit_low THEN 1 END) AS n FROM live, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS firm), (SELECT unnest([100.0, 200.0, 300.0]::DOUBLE[]) AS limit_low) GROUP BY 1, 2",
    }


ORACLES = _oracles()
