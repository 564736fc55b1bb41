"""Impulse responses, their inverse, and statistics of spike trains and background traces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAD_SCALE, over
from .selection import long_keys, medians


def double_exp(tau1: float = 0.08, tau2: float = 0.16, duration: float = 1.0, hz: float = 20.0) -> tuple[int, float, float, float]:
    """(size, fast, slow, scale): decay times in frames, fast < slow, and the factor that brings
    the continuous response's maximum to 1."""
    fast, slow = sorted((tau1 * hz, tau2 * hz))
    ratio, gap = fast / slow, fast - slow
    return math.ceil(duration * hz), fast, slow, ratio ** (-slow / gap) - ratio ** (-fast / gap)


def kernel(spark: SparkSession, **given: float) -> DataFrame:
    """kernel(j, w): one row a frame of the response, a few dozen rows."""
    size, fast, slow, scale = double_exp(**given)
    t = F.col("id") + 1
    return spark.range(size).select(F.col("id").cast("int").alias("j"), ((F.exp(-t / fast) - F.exp(-t / slow)) / scale).alias("w"))


def kernels(settings: DataFrame, name: str) -> DataFrame:
    """(name, j, w): the response of every row of ``settings`` (name, tau1, tau2, duration, hz), by the same
    rule as ``double_exp``. Decay times are taken in either order; rows with a null, equal or
    non-positive decay time have no response."""
    fast, slow = F.least("tau1", "tau2") * F.col("hz"), F.greatest("tau1", "tau2") * F.col("hz")
    sized = settings.where("tau1 > 0 and tau2 > 0 and tau1 <> tau2 and duration * hz > 0").select(name, fast.alias("fast"), slow.alias("slow"), F.ceil(F.col("duration") * F.col("hz")).cast("int").alias("size"))
    ratio, gap = F.col("fast") / F.col("slow"), F.col("fast") - F.col("slow")
    scale = F.pow(ratio, -F.col("slow") / gap) - F.pow(ratio, -F.col("fast") / gap)
    t = F.col("j") + 1
    rows = sized.withColumn("scale", scale).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return rows.select(name, "j", ((F.exp(-t / F.col("fast")) - F.exp(-t / F.col("slow"))) / F.col("scale")).alias("w"))


def spike_to_calcium(spikes: DataFrame, response: DataFrame, size: int, frames: int) -> DataFrame:
    """(spkid, t, v): spikes at u answer in frames u - size + 1 + j. Sparse in, sparse out; the
    kernel is broadcast and answers add up in each task before the shuffle."""
    spread = spikes.crossJoin(F.broadcast(response)).select("spkid", (F.col("u") - (size - 1) + F.col("j")).cast("int").alias("t"), (F.col("v") * F.col("w")).alias("v"))
    return spread.where(F.col("t").between(0, frames - 1)).groupBy("spkid", "t").agg(F.sum("v").alias("v"))


def calcium_to_spike(calcium: DataFrame, **given: float) -> DataFrame:
    """(id, u, v): the three-tap inverse of the response on dense traces (id, t, v), after as many
    zeros as the response is long plus one; the row's minimum is added."""
    size, fast, slow, scale = double_exp(**given)
    e1, e2 = math.exp(-1 / fast), math.exp(-1 / slow)
    unit = scale / (e1 - e2)
    w = Window.partitionBy("id").orderBy("t")
    value = (F.col("v") - (e1 + e2) * F.lag("v", 1).over(w) + e1 * e2 * F.lag("v", 2).over(w)) * unit
    tail = calcium.select("id", (F.col("t") + size - 1).alias("u"), value.alias("v")).where("v is not null")
    head = calcium.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(size))).alias("u"), F.lit(0.0).alias("v"))
    every = head.unionByName(tail)
    return every.select("id", F.col("u").cast("int").alias("u"), (F.col("v") + F.min("v").over(Window.partitionBy("id"))).alias("v"))


def spike_stats(spikes: DataFrame, length: int) -> DataFrame:
    """(spkid, signal, udense, unz, snratio, rsn) of sparse trains of ``length`` places; snratio is the largest
    value over the scaled median of the positive ones, null without any."""
    found = medians(spikes, F.when(F.col("v") > 0, F.col("v")), "spkid", signal=F.max("v"), total=F.sum("v"), unz=F.count(F.when(F.col("v") > 0, 1)))
    found = found.withColumn("snratio", over(F.col("signal"), MAD_SCALE * F.col("median")))
    return found.select("spkid", "signal", over(F.col("total") / length, F.col("signal")).alias("udense"), "unz", "snratio", over(F.lit(1.0), F.col("snratio")).alias("rsn"))


def background_stats(traces: DataFrame) -> DataFrame:
    """(id, bmax, bsparse) of signed traces."""
    size = F.abs(F.col("v"))
    found = medians(traces, F.when(F.col("v") != 0, size), "id", bmax=F.max(size), top=F.max("v"))
    return found.select("id", "bmax", over(F.col("top"), MAD_SCALE * F.col("median")).alias("bsparse"))


def robust_levels(rows: DataFrame, *columns: str) -> DataFrame:
    """(metric, mid, spread): median and scaled median deviation of several columns, selected together."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.metric", "e.v")
    many = long_keys(long, "v", "metric")
    mid = medians(long, "v", "metric", long=many).withColumnRenamed("median", "mid")
    apart = medians(long.join(F.broadcast(mid), "metric"), F.abs(F.col("v") - F.col("mid")), "metric", long=many, mid=F.first("mid"))  # a row a column
    return apart.select("metric", "mid", (MAD_SCALE * F.col("median")).alias("spread"))


def robust_zscore(rows: DataFrame, **named: str) -> DataFrame:
    """Add, under each name, the distance of a column from its median in scaled median deviations; null where
    the deviation is zero. One row is broadcast."""
    levels = robust_levels(rows, *named.values())
    one = levels.agg(*[F.first(F.when(F.col("metric") == c, F.col(part)), ignorenulls=True).alias(f"_{part}_{c}") for c in named.values() for part in ("mid", "spread")])
    scored = rows.crossJoin(F.broadcast(one))
    return scored.withColumns({out: over(F.col(c) - F.col(f"_mid_{c}"), F.col(f"_spread_{c}")) for out, c in named.items()}).drop(*one.columns)


def mahalanobis(rows: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Add the Mahalanobis distance of (x, y) from the mean of all rows (population covariance)."""
    one = rows.agg(*[f(c).alias(n) for f, c, n in ((F.avg, x, "_mx"), (F.avg, y, "_my"), (F.var_pop, x, "_vx"), (F.var_pop, y, "_vy"))], F.covar_pop(x, y).alias("_c"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    det = F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c")
    value = F.sqrt(over(F.col("_vy") * dx * dx - 2 * F.col("_c") * dx * dy + F.col("_vx") * dy * dy, det))
    return rows.crossJoin(F.broadcast(one)).withColumn(out, value).drop("_mx", "_my", "_vx", "_vy", "_c")


def in_bins(value: Column, edges: list[float]) -> Column:
    """Number of the half-open bin that holds a value, the last bin closed; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        upper = value <= edges[i + 1] if i == len(edges) - 2 else value < edges[i + 1]
        out = F.when((value >= edges[i]) & upper, F.lit(i)).otherwise(out)
    return out


def damp_top(traces: DataFrame, key: str = "id", place: str = "t") -> DataFrame:
    """Each row's largest value replaced by its second largest; ties fall on the least place."""
    w = Window.partitionBy(key).orderBy(F.desc("v"), place)
    ranked = traces.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("v").over(w))
    return ranked.withColumn("v", F.when(F.col("_k") == 1, F.coalesce("_next", "v")).otherwise(F.col("v"))).drop("_k", "_next")
