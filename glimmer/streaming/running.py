"""Running statistics over streams of events and of movie frames, with Spark's own state for each key.

A batch writes the keys that it changed; the latest row of each key is the state so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import pixel_moments
from ..sources.store import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 4) -> DataFrame:
    """A table's files as a stream; a table may be one file or a folder of files."""
    whole = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    files = whole.inputFiles()
    reader = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files_a_batch)
    if files and files[0].rstrip("/").endswith(f"{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def running_stats(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """Count, sum, extremes and the latest argmax of every key so far."""
    return events.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col("event_id")).alias("e"))).alias("top"),
    )


def running_products(frames: DataFrame) -> DataFrame:
    """(row, p, v): the product of a matrix and the movie, added up as frames arrive: each frame
    counts for its row with its mean as the weight."""
    mean = F.aggregate("px", F.lit(0.0), lambda a, v: a + v) / F.size("px")
    return frames.select("row", mean.alias("w"), F.posexplode("px").alias("p", "x")).groupBy("row", "p").agg(F.sum(F.col("w") * F.col("x")).alias("v"))


def movie_moments(frames: DataFrame, height: int, width: int) -> DataFrame:
    """The moments of every pixel (``normalize.pixel_moments``) over the frames so far. Sums, extremes and
    co-moments do not depend on the order of frames: one that comes late counts when it comes,
    one that comes twice counts twice, and a null or misshapen frame counts for nothing."""
    return pixel_moments(frames, height, width)


def hourly(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Windowed counts and sums under a watermark: windows close, and rows that are later still are dropped.
    With None no row is, and every window stays in the state."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late is not None:
        stamped = stamped.withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, spark: SparkSession, *keys: str) -> DataFrame:
    """Run a stream over everything that is there. With ``keys``, the latest row of each key; without, all that
    the stream appends."""
    return latest(changes(stream, spark, "update" if keys else "append"), *keys)


def changes(stream: DataFrame, spark: SparkSession, mode: str = "update") -> DataFrame:
    """What each batch of a stream wrote, with the column ``batch``. A batch that runs again after a failure
    replaces its own folder, so no change counts twice."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    ran = set()

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")
        ran.add(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/changes") if ran else spark.createDataFrame([], schema)


def latest(changed: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key by ``batch``, combined in each task before the shuffle."""
    if not keys:
        return changed.drop("batch")
    rest = [c for c in changed.columns if c not in (*keys, "batch")]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")
