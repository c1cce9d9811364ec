"""Session settings that the engine's semantics rely on, and shipping of the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Run-time settings: exact decimals, UTC instants, errors instead of wrapped numbers.
FIXED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.csv.parser.columnPruning.enabled": "false",
}

_shipped: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the fixed settings to a session and return it."""
    for key, value in FIXED_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Executors of a cluster need not have it installed: a zip file of the package goes
    to them through Spark's file server.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
