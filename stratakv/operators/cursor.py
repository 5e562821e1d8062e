"""Navigation: each move is a query of its own that gives no row or one; batches of moves are joins.

A sorted dataset's block index bounds the moves to one block: without it "the first key at or above k" is true for
the whole rest of the data, all of which would be read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.plans.ranged import as_of, with_neighbours

#: Distinct probes up to which a batch of seeks names the ranges to read, and ranges that it names at most.
NAMED_PROBES, NAMED_RANGES = 16_384, 16
#: Probes of a block, on average, up to which entries are compared with the probes of their block; more are sorted among them.
SPARSE = 16
#: Bytes of distinct probes, as measured, up to which they are broadcast; bytes that a row takes beside its columns, about.
MOST_BROADCAST, ROW_BYTES = 8 << 20, 64


def first(entries: DataFrame) -> DataFrame:
    return entries.orderBy("key").limit(1)


def last(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("key")).limit(1)


def at_or_above(entries: DataFrame, key: Any, index: DataFrame | None = None, strictly: bool = False) -> DataFrame:
    """The entry with the smallest key at (unless strictly) or above key. index: blocks (first_key, last_key)."""
    k = F.col("key")
    some = entries.where(k > F.lit(key) if strictly else k >= F.lit(key))
    if index is not None:
        stop = F.col("last_key")
        block = index.where(stop > F.lit(key) if strictly else stop >= F.lit(key)).agg(F.min("last_key").alias("k")).first().k
        if block is None:
            return entries.where(F.lit(False))
        some = some.where(k <= F.lit(block))
    return first(some)


def at_or_below(entries: DataFrame, key: Any, index: DataFrame | None = None, strictly: bool = False) -> DataFrame:
    """The entry with the largest key at (unless strictly) or below key."""
    k = F.col("key")
    some = entries.where(k < F.lit(key) if strictly else k <= F.lit(key))
    if index is not None:
        start = F.col("first_key")
        block = index.where(start < F.lit(key) if strictly else start <= F.lit(key)).agg(F.max("first_key").alias("k")).first().k
        if block is None:
            return entries.where(F.lit(False))
        some = some.where(k >= F.lit(block))
    return last(some)


def equal_to(entries: DataFrame, key: Any) -> DataFrame:
    return entries.where(F.col("key") == F.lit(key))


def after(entries: DataFrame, key: Any = None, index: DataFrame | None = None) -> DataFrame:
    """The next entry behind key; the first one for None."""
    return first(entries) if key is None else at_or_above(entries, key, index, strictly=True)


def before(entries: DataFrame, key: Any = None, index: DataFrame | None = None) -> DataFrame:
    """The entry before key; the last one for None."""
    return last(entries) if key is None else at_or_below(entries, key, index, strictly=True)


def walk(entries: DataFrame) -> DataFrame:
    """entries with prev_key and next_key."""
    return with_neighbours(entries)


def equal_to_many(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """(probe, key, val) for each probe row, nulls where the key is missing. Few distinct probes are broadcast to the entries; more, and the entries, are sorted.

    Which side is broadcast is not left to Spark: it takes a table to be as large as its compressed files, and sorted keys are many times that in memory.
    """
    asked = probes.select("probe").where("probe is not null").distinct()
    few = _met(asked.agg(_bytes("probe").alias("n")).first().n)
    return _each(probes, _sorted(few(asked).join(entries.select("key", "val"), F.col("probe") == F.col("key"))))


def _bytes(*columns: str) -> Column:
    """What rows of these columns take in memory, about, as an aggregate."""
    return F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(ROW_BYTES)))


def _met(held: int | None) -> Callable[[DataFrame], DataFrame]:
    """A hint for probes that are joined to entries, by the bytes that they hold."""
    return F.broadcast if (held or 0) <= MOST_BROADCAST else _sorted


def _sorted(df: DataFrame) -> DataFrame:
    """df for a join that sorts both sides, whatever size Spark takes them to have."""
    return df.hint("merge")


def at_or_above_many(probes: DataFrame, entries: DataFrame) -> DataFrame:
    return _each(probes, as_of(probes, entries, False))


def at_or_below_many(probes: DataFrame, entries: DataFrame) -> DataFrame:
    return _each(probes, as_of(probes, entries, True))


def _each(probes: DataFrame, found: DataFrame) -> DataFrame:
    """Found entries of distinct probes, for each probe row."""
    return probes.select("probe").join(found.withColumnRenamed("probe", "__p"), F.col("probe") == F.col("__p"), "left").select("probe", "key", "val")


def hits(probes: DataFrame, index: DataFrame, up: bool) -> DataFrame:
    """(probe, file, block, first_key, last_key): the block that holds the entry at or above (up) or below each distinct probe. index: (file, block, first_key, last_key)."""
    end = index.select(F.col("last_key" if up else "first_key").alias("key"), F.struct("file", "block", "first_key", "last_key").alias("val"))
    return as_of(probes, end, not up).where("val is not null").select("probe", "val.*")


def named(probes: DataFrame, index: DataFrame, up: bool) -> tuple[DataFrame, list[Row] | None]:
    """hits(), and its rows if there are NAMED_PROBES or fewer; with as few blocks these are found without a job of their own."""
    asked = probes.select("probe").where("probe is not null").distinct().limit(NAMED_PROBES + 1).collect()
    if len(asked) > NAMED_PROBES:
        return hits(probes, index, up), None
    blocks = index.select("file", "block", "first_key", "last_key").limit(NAMED_PROBES + 1).collect()
    if len(blocks) > NAMED_PROBES:
        found = hits(probes, index, up)
        rows = found.collect()
    else:
        blocks.sort(key=lambda r: r.last_key)
        ends = [r.last_key if up else r.first_key for r in blocks]
        spots = [bisect.bisect_left(ends, r.probe) if up else bisect.bisect_right(ends, r.probe) - 1 for r in asked]
        rows = [Row(probe=r.probe, **blocks[k].asDict()) for r, k in zip(asked, spots, strict=True) if 0 <= k < len(blocks)]
    kinds = T.StructType([probes.schema["probe"], *(index.schema[c] for c in ("file", "block", "first_key", "last_key"))])
    return probes.sparkSession.createDataFrame(rows, kinds), rows


def blocks_read(entries: DataFrame, rows: list[Row] | None) -> DataFrame:
    """entries within the key ranges of the blocks that rows of hits() name, as predicates that reach the scan; all entries for None. Blocks that adjoin make one range."""
    if rows is None:
        return entries
    ranges: list[list[Any]] = []
    before = None
    for first_key, last_key, file, block in sorted({(r.first_key, r.last_key, r.file, r.block) for r in rows}):
        if before == (file, block - 1):
            ranges[-1][1] = last_key
        else:
            ranges.append([first_key, last_key])
        before = (file, block)
    step = max(1, -(-len(ranges) // NAMED_RANGES))
    condition = F.lit(False)
    for at in range(0, len(ranges), step):
        condition = condition | F.col("key").between(F.lit(ranges[at][0]), F.lit(ranges[min(at + step, len(ranges)) - 1][1]))
    return entries.where(condition)


def _in(probes: DataFrame, entries: DataFrame, index: DataFrame, up: bool) -> DataFrame:
    """at_or_above_many() or at_or_below_many() over entries (key, val, file, block, row) of a dataset with a block index; row numbers a file's entries.

    The probes are looked up in the index, and only the blocks hit are read. Each entry meets the probes of its own block, and what
    they need of it is aggregated before anything moves, so values are not shuffled. Where a block has many probes they are sorted among its entries instead.
    """
    found, rows = named(probes, index, up)
    entries = blocks_read(entries, rows)
    asked = found.groupBy("file", "block").agg(F.array_sort(F.collect_list("probe")).alias("probes"))
    few = F.broadcast  # NAMED_PROBES rows at most
    if rows is None:
        mean, held = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), _bytes("probe", "file").alias("held")).agg(F.avg("n"), F.sum("held")).first()
        mean, few = mean or 0, _met(held)
    else:
        mean = len(rows) / max(1, len({(r.file, r.block) for r in rows}))
    if mean > SPARSE:
        return _each(probes, as_of(probes, entries.select("key", "val"), not up))
    met = entries.select("key", "file", "block", "row").join(few(asked), ["file", "block"])
    near = F.filter("probes", (lambda p: p <= F.col("key")) if up else (lambda p: p >= F.col("key")))
    best = F.min if up else F.max  # entries are numbered by key, and numbers are aggregated without a sort
    served = met.select("file", "block", (F.array_max(near) if up else F.array_min(near)).alias("at"), "row").where("at is not null")
    served = served.groupBy("file", "block", "at").agg(best("row").alias("row"))  # a row for each probe at most
    reached = few(found.select("probe", "file", "block")).join(served, ["file", "block"]).where(F.col("at") >= F.col("probe") if up else F.col("at") <= F.col("probe"))
    reached = reached.groupBy("probe", "file").agg(best("row").alias("row"))  # a row for each probe
    return _each(probes, few(reached).join(entries, ["file", "row"]).select("probe", "key", "val"))


def at_or_above_in(probes: DataFrame, entries: DataFrame, index: DataFrame) -> DataFrame:
    return _in(probes, entries, index, True)


def at_or_below_in(probes: DataFrame, entries: DataFrame, index: DataFrame) -> DataFrame:
    return _in(probes, entries, index, False)


def equal_to_in(probes: DataFrame, entries: DataFrame, index: DataFrame) -> DataFrame:
    return equal_to_many(probes, blocks_read(entries, named(probes, index, True)[1]))
