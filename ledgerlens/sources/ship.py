"""The package on the Python workers of a session, however the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the modules of this package to every executor, once per application.

    Executors fetch the archive from the driver, so they need neither its folders nor an
    installation. Readers whose tasks run functions of this package call it themselves.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="ledgerlens-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(PACKAGE.rglob("*.py")):
            out.write(module, module.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
