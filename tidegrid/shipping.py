"""Makes this package importable in Python workers, wherever the driver has found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_shipping = Lock()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors, once an application; a few dozen kB.

    Fits that go on side by side all ask for it: a cluster refuses a second file of the same name.
    """
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidegrid-")) / "tidegrid_sources.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(path.relative_to(root.parent)))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
