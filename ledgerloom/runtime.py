"""Sends this package's modules to the executors, so that a session need not be started with them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: An Arrow batch is cut at this many bytes, so that a worker's memory does not follow the length of texts.
BATCH_BYTES = 16 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp())
    name = os.path.join(folder, f"{package.name}-modules.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` whose function may come from this package."""
    ship(df.sparkSession)
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
