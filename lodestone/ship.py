"""Give Python workers this package, whether or not their machines have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package's sources to the application's files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # the driver serves the file to executors itself, so its own disk is the place for it
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}_sources.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
