"""Range and prefix scans in both directions, as predicates on the key that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.functions.keys import after_prefix
from stratakv.model import UNBOUNDED, Bound, excluded, included


def within(entries: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
    """Entries between two bounds, in no order. A range whose start is behind its end has none."""
    key = F.col("key")
    for condition in (start.above(key), end.below(key)):
        if condition is not None:
            entries = entries.where(condition)
    return entries


def range_scan(entries: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
    return within(entries, start, end).orderBy("key")


def rev_range_scan(entries: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
    return within(entries, start, end).orderBy(F.desc("key"))


def with_prefix(entries: DataFrame, prefix: bytes) -> DataFrame:
    """Entries whose binary key starts with the prefix, as a range: Spark does not push down a prefix test of bytes."""
    stop = after_prefix(prefix)
    return within(entries, included(prefix) if prefix else UNBOUNDED, UNBOUNDED if stop is None else excluded(stop))


def prefix_scan(entries: DataFrame, prefix: bytes) -> DataFrame:
    return with_prefix(entries, prefix).orderBy("key")


def rev_prefix_scan(entries: DataFrame, prefix: bytes) -> DataFrame:
    return with_prefix(entries, prefix).orderBy(F.desc("key"))
