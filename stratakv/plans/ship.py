"""Python code of the library for executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import stratakv

#: Applications that have the code already.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(stratakv.__file__).parent
    place = os.path.join(tempfile.mkdtemp(prefix="stratakv-"), "stratakv.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(os.path.realpath(place))
