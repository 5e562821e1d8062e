"""A folder that all executors share, for tables written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir; a temporary folder only where none is set on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = tempfile.gettempdir()
    return f"{place}/stratakv-{name}-{uuid.uuid4().hex}"
