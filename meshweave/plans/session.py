"""Getting this package to the executors of any session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that group functions import there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="meshweave-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


#: Bytes of an Arrow batch between the JVM and Python, of which each task holds a few at once.
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """What a session needs before it runs operators with Python tasks; call it once.

    Ships this package and bounds the session's Arrow batches by ARROW_BYTES where
    spark.sql.execution.arrow.maxBytesPerBatch allows more, so that ten thousand long texts are
    never one batch. No operator changes a setting by itself.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
