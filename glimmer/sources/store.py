"""Stage tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on a single machine, as in tests, a temporary folder stands in for
    it; on a cluster a session without it is an error, as executors could not share one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='glimmer-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and reread, so that an iteration or a stage starts from files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(base: str, entry: str, stage: int) -> str:
    """Where a stage keeps an entry; partition folders let one read gather all stages."""
    return f"{base}/{entry}/stage={stage:03d}"


def save_stage(df: DataFrame, base: str, entry: str, stage: int) -> None:
    df.write.mode("overwrite").parquet(stage_path(base, entry, stage))


def load_stage(spark: SparkSession, base: str, entry: str, stage: int) -> DataFrame | None:
    """The entry of a stage, or None where it is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(stage_path(base, entry, stage))
    except AnalysisException:
        return None


def load_stages(spark: SparkSession, base: str, entry: str) -> DataFrame:
    """An entry over all stages, with the column ``stage``."""
    return spark.read.parquet(f"{base}/{entry}")
