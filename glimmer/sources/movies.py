"""Movies, masks and traces from tables and from array files.

A movie is either packed, ``frames(t, px)`` with one row-major array a frame, or long,
``pixels(t, y, x, v)``. Frame operators run on the packed form without any shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .array_files import MovieFiles

SIDE = 8
HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(t, px): every embedding as a frame of SIDE x SIDE pixels."""
    px = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("t"), px.alias("px"))


def pixels(frames: DataFrame, width: int = SIDE) -> DataFrame:
    """pixels(t, y, x, v) of packed frames."""
    p = frames.select("t", F.posexplode("px").alias("p", "v"))
    return p.select("t", (F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), "v")


def ring_mask(frames: DataFrame, width: int = SIDE) -> DataFrame:
    """mask(y, x): the pixels off the outer ring whose mean over time is above the mean of all."""
    inner = F.col("y").between(1, width - 2) & F.col("x").between(1, width - 2)
    means = pixels(frames, width).where(inner).groupBy("y", "x").agg(F.avg("v").alias("m"))
    level = means.agg(F.avg("m").alias("level"))
    return means.join(F.broadcast(level), F.col("m") > F.col("level")).select("y", "x")


def crop_to_mask(px: DataFrame, mask: DataFrame) -> DataFrame:
    """The movie inside the mask, moved so that the mask's bounding box starts at 0, 0."""
    corner = mask.agg(F.min("y").alias("y0"), F.min("x").alias("x0"))
    inside = px.join(mask, ["y", "x"], "left_semi").join(F.broadcast(corner))  # one row
    return inside.select("t", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def chosen_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames named by ``wanted(t)``, with their repeats in ``wanted`` dropped."""
    return frames.join(wanted.select("t").distinct(), "t", "left_semi")


def series(px: DataFrame) -> DataFrame:
    """series(y, x, n, first, last): length and ends of each pixel's values in the order of time,
    combined in each task before the shuffle."""
    return px.groupBy("y", "x").agg(F.count("*").alias("n"), F.min_by("v", "t").alias("first"), F.max_by("v", "t").alias("last"))


def mask_of(frames: DataFrame, width: int) -> DataFrame:
    """mask(y, x) of an image read as the first frame of a movie: where it is not zero."""
    first = frames.orderBy("t").limit(1)
    return pixels(first, width).where("v <> 0").select("y", "x")


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spikes(spkid, u, v > 0): what purchases of a user exceed 100 by, summed by hour."""
    hour = (F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("int")
    value = F.greatest(F.col("value") - 100.0, F.lit(0.0))
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").cast("int").alias("spkid"), hour.alias("u")).agg(F.sum(value).alias("v"))
    return rows.where("v > 0 and u >= 0")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traces(id, t, v): quantity by supplier and month since 1995-01, dense, minus the supplier's mean."""
    rows = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 12 * 1995 - 1).cast("int")
    sums = rows.groupBy(F.col("l_suppkey").cast("int").alias("id"), month.alias("t")).agg(F.sum("l_quantity").alias("q"))
    held = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "q"))).alias("m"))
    last = sums.agg(F.max("t").alias("last"))
    dense = held.join(F.broadcast(last)).select("id", "m", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t"))  # one row
    filled = dense.select("id", "t", F.coalesce(F.element_at("m", F.col("t")), F.lit(0.0)).alias("q"))
    mean = filled.groupBy("id").agg(F.avg("q").alias("mean"))
    return filled.join(mean, "id").select("id", "t", (F.col("q") - F.col("mean")).alias("v"))


def read_files(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """frames(t, px) of movie files of a kind (npy, raw or tif), read in ranges of frames by many tasks; t runs
    on from file to file by name. A file of another form, or cut short, is a named error; one without
    frames has no rows."""
    spark.dataSource.register(MovieFiles)
    return spark.read.format(MovieFiles.name()).options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()


def read_raw(spark: SparkSession, path: str, height: int, width: int, dtype: str = "<u2") -> DataFrame:
    """Headerless files of whole frames."""
    return read_files(spark, path, "raw", height=height, width=width, dtype=dtype)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(t, y, x) array files."""
    return read_files(spark, path, "npy")


def read_tif(spark: SparkSession, path: str, copy: str | None = None) -> DataFrame:
    """Multi-page grey-scale files, uncompressed. With ``copy``, a folder, the frames are written there once
    as Parquet, and read from there from then on."""
    found = read_files(spark, path, "tif")
    if copy is None:
        return found
    try:
        return spark.read.parquet(copy)
    except AnalysisException:
        found.write.parquet(copy)
        return spark.read.parquet(copy)
