"""Statistics of a movie and its normalisation. Sums combine in each task before any shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencils import by_frame, image_rows, neighbor_mean


def frame_means(frames: DataFrame) -> DataFrame:
    """(t, avgt), within the row."""
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    return frames.select("t", F.try_divide(total, F.size("px")).alias("avgt"))


def inside_of(mask: DataFrame | None, height: int, width: int) -> np.ndarray | None:
    """A mask(y, x) as an array of one frame, which the tasks get; places off the frame and repeats do not
    count, and a mask without a place on the frame is an error."""
    if mask is None:
        return None
    inside = np.zeros((height, width), bool)
    on = mask.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select("y", "x").distinct()  # a frame's size at most
    for row in on.collect():
        inside[row["y"], row["x"]] = True
    if not inside.any():
        raise ValueError("the mask holds no pixel of the frame")
    return inside


def centred(frames: DataFrame, height: int, width: int, mask: DataFrame | None = None) -> DataFrame:
    """(t, y, x, v, d, n): value, value minus its frame's mean (over the mask, if any), and the mean of d's neighbours."""
    inside = inside_of(mask, height, width)

    def work(t, images):
        mean = images.mean((-2, -1)) if inside is None else images[:, inside].mean(-1)
        diff = images - mean[:, None, None]
        rows = image_rows(t, images)
        return rows | {"d": diff.ravel(), "n": np.ascontiguousarray(neighbor_mean(diff)).ravel()}

    return by_frame(frames, height, width, work, "t int, y int, x int, v double, d double, n double")


def pixel_moments(frames: DataFrame, height: int, width: int, mask: DataFrame | None = None) -> DataFrame:
    """One row a pixel: mean, population variance, extremes and neighbour correlation over time. A mask only
    says over which pixels a frame's mean goes; pixels outside it have rows too."""
    return centred(frames, height, width, mask).groupBy("y", "x").agg(
        F.avg("d").alias("avgx"), F.var_pop("d").alias("var"), F.max("d").alias("high"), F.min("d").alias("low"),
        F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.try_divide(F.covar_pop("d", "n"), F.sqrt(F.var_pop("d") * F.var_pop("n"))).alias("icor"),
    )


def scalar_stats(moments: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """One row: std0, over the pixels of a mask if there is one, and the extremes of all pixels before and
    after normalisation."""
    own = moments if mask is None else moments.join(mask.select("y", "x").distinct(), ["y", "x"], "left_semi")
    std = own.agg(F.sqrt(F.avg("var")).alias("std0"))
    return moments.crossJoin(F.broadcast(std)).agg(  # one row
        F.first("std0").alias("std0"), F.min("vmin").alias("min0"), F.max("vmax").alias("max0"),
        F.min(F.try_divide(F.col("low") - F.col("avgx"), F.col("std0"))).alias("min1"),
        F.max(F.try_divide(F.col("high") - F.col("avgx"), F.col("std0"))).alias("max1"),
    )


def pixel_stats(moments: DataFrame, scalars: DataFrame) -> DataFrame:
    """(y, x, avgx, imax, imin, istd, icor)."""
    unit = F.col("std0")
    return moments.crossJoin(F.broadcast(scalars.select("std0"))).select(
        "y", "x", "avgx",
        F.try_divide(F.col("high") - F.col("avgx"), unit).alias("imax"),
        F.try_divide(F.col("low") - F.col("avgx"), unit).alias("imin"),
        F.try_divide(F.sqrt("var"), unit).alias("istd"), "icor",
    )


def normalized(frames: DataFrame, moments: DataFrame, scalars: DataFrame, height: int, width: int) -> DataFrame:
    """frames(t, px) brought to (v - avgx - avgt) / std0. The mean image is one row of a frame's
    size, so it is broadcast and the movie is not shuffled."""
    image = moments.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "avgx"))), lambda s: s["avgx"]).alias("avgx"))
    mean = F.try_divide(F.aggregate("px", F.lit(0.0), lambda a, v: a + v), F.size("px"))
    with_mean = frames.withColumn("_mean", mean)
    return with_mean.crossJoin(F.broadcast(image)).crossJoin(F.broadcast(scalars.select("std0"))).select(
        "t", F.transform(F.arrays_zip("px", "avgx"), lambda z: F.try_divide(z["px"] - z["avgx"] - F.col("_mean"), F.col("std0"))).alias("px")
    )
