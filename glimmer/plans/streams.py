"""Queries that run as streams over everything that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import normalize as N
from ..sources.store import materialise
from ..streaming import running as R
from .movie import ORACLES as MOVIE
from .movie import SIDE, r


def running_stats_stream(spark, d):
    out = R.drain(R.running_stats(R.read_stream(spark, d, "events")), spark, "user_id")
    return out.select("user_id", "n", tidy("total", 4).alias("total"), tidy("low").alias("low"), tidy("high").alias("high"), (-F.col("top.e")).alias("first_top"))


def hourly_stream(spark, d):
    out = R.drain(R.hourly(R.read_stream(spark, d, "events"), None), spark, "w")
    return out.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH").alias("hour"), "n", tidy("total", 4).alias("total"))


def running_products_stream(spark, d):
    """Per label, the sum over its frames of the frame's mean times its pixels."""
    frames = R.read_stream(spark, d, "embeddings").select(F.col("label").alias("row"), F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    return R.drain(R.running_products(frames), spark, "row", "p").select("row", "p", tidy("v", 4).alias("v"))


def movie_stats_stream(spark, d):
    """The statistics of every pixel, from a stream of frames."""
    frames = R.read_stream(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    found = materialise(R.drain(R.movie_moments(frames, SIDE, SIDE), spark, "y", "x"), "moments")
    out = N.pixel_stats(found, N.scalar_stats(found))
    return out.select("y", "x", *[tidy(c).alias(c) for c in ("avgx", "imax", "imin", "istd", "icor")])


QUERIES = {f.__name__: f for f in (running_stats_stream, hourly_stream, running_products_stream, movie_stats_stream)}
ORACLES = {
    "movie_stats_stream": MOVIE["pixel_stats"],
    "running_products_stream": f"""SELECT label AS row, CAST(i - 1 AS INTEGER) AS p, {r('sum(m * CAST(embedding[i] AS DOUBLE))', 4)} AS v
      FROM (SELECT label, embedding, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings), range(1, 65) k(i) GROUP BY 1, 2""",
    "running_stats_stream": f"SELECT user_id, count(*) AS n, {r('sum(value)', 4)} AS total, {r('min(value)')} AS low, {r('max(value)')} AS high, (array_agg(event_id ORDER BY value DESC, event_id))[1] AS first_top FROM events GROUP BY user_id",
    "hourly_stream": f"SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY 1",
}
