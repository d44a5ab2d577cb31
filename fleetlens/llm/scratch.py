"""Intermediate tables in the shared folder, and the package on its way to the workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import scratch_path

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        to = tempfile.mkdtemp(prefix="fleetlens-package-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(app)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back, with the same schema.

    A stored table cuts the lineage: executors may be lost at any time and the plan restarts from the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
