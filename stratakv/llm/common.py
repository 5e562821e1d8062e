"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts count it: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set on one machine, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="stratakv-checkpoint-")
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Tables written by cut() that are still there.
_WRITTEN: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there, so that nothing above is computed twice.

    A table rather than checkpoint(): Spark keeps a checkpoint's inferred constraints, and in loops they multiply
    until planning takes all of the driver's memory. The tables go by dropped(), or else when the driver ends.
    """
    spark = df.sparkSession
    if not _WRITTEN:
        atexit.register(_forget)
    place = f"{checkpoint_dir(spark)}/stratakv-{uuid.uuid4().hex}"
    _WRITTEN[place] = spark
    df.write.parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out._place = place
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables written by cut() that nothing reads any more."""
    for df in tables:
        if place := getattr(df, "_place", None):
            _delete(_WRITTEN.pop(place, None), place)


def _delete(spark: SparkSession | None, place: str) -> None:
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget() -> None:
    for place, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, place)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, BLANK_CLASS + "+"))).cast("long")


Batches = Iterator[pa.RecordBatch]


def lean(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """fn for mapInArrow in a worker that gives memory back: Arrow's own pool keeps what it has freed, and workers wait idle beside others."""

    def run(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """fn over each batch, in slices of bounded bytes, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return lean(run)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes; a longer row stands alone."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty bytes."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]
