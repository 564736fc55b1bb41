"""Sends this package to the executors where they cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def importable() -> bool:
    """Whether workers started from here find the package: by PYTHONPATH or the working folder."""
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == ROOT for p in paths)


def ship(spark: SparkSession) -> None:
    """Once a Spark context: add the package's sources as a file that Spark serves to its workers."""
    context = spark.sparkContext
    if importable() or getattr(context, "_glimmer_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="glimmer-code-"))
    target = os.path.join(folder, "glimmer_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(ROOT.joinpath("glimmer").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    context.addPyFile(target)
    context._glimmer_shipped = True
