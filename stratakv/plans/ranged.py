"""Whole-table windows over a key, without one task for all rows.

A window without partitions puts all rows in one task. Here the key's range is cut at sampled boundaries into
buckets, windows run inside buckets, and what a bucket needs from the ones before or behind it (a count, a last
or first entry) is carried over from one small row for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.plans.scratch import scratch

#: Keys that boundaries are taken from; ranges of a level, at most, of which there are two; sampled keys for each range of the second.
SAMPLE = 10_000
WIDE = 512
PER_RANGE = 20
#: Bytes of the leaves a range stands for, about.
RANGE_BYTES = 512 << 20
#: Bytes (characters of strings) of a cut of the second level; a longer key is cut at its prefix. So its cuts are 64 MB of bytes at most.
CUT_BYTES = 256
#: xxhash64 is spread over this many values, from -HASHES / 2 on.
HASHES = 1 << 64


def leaf_bytes(df: DataFrame) -> int:
    """What Spark takes df's inputs to hold; those it knows no size of count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 62)


def bucket_of(key: Column, cuts: Sequence[Any]) -> Column:
    """The number of cuts at or below the key, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


@dataclass(frozen=True)
class Ranges:
    """Ranges of keys, numbered in their order. cuts: boundaries of the first level; inner: (__outer, cuts), a row for each of its ranges with the at most `each` - 1 boundaries inside."""

    cuts: list[Any]
    each: int = 1
    inner: DataFrame | None = None

    @property
    def count(self) -> int:
        return (len(self.cuts) + 1) * self.each

    def put(self, df: DataFrame, key: str) -> DataFrame:
        """df with __bucket, the range of each row's key."""
        outer = bucket_of(F.col(key), self.cuts)
        if self.inner is None:
            return df.withColumn("__bucket", outer)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(self.each.bit_length()))])
        joined = df.withColumn("__outer", outer).join(F.broadcast(self.inner), "__outer", "left")  # CUT_BYTES * WIDE * WIDE bytes at most
        below = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size("__cuts")) & (F.get("__cuts", n + s - 1) <= F.col(key)), n + s).otherwise(n))
        return joined.withColumn("__bucket", F.col("__outer") * self.each + F.coalesce(below, F.lit(0))).drop("__outer", "__cuts")

    @property
    def few(self) -> Callable[[DataFrame], DataFrame]:
        """A hint for a table of one row a range: broadcast if they are of one level. Else it moves to where the windows have put the ranges."""
        return F.broadcast if self.inner is None else lambda df: df


def ranges(df: DataFrame, key: str = "key", buckets: int | None = None) -> Ranges:
    """Ranges that cut the rows evenly: `buckets`, or as many as shuffle partitions or as RANGE_BYTES asks for, WIDE * WIDE at most. Keys are sampled by their hash, so that reruns agree."""
    wanted = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaf_bytes(df) // RANGE_BYTES))
    wanted = min(WIDE * WIDE, wanted)
    if wanted < 2:
        return Ranges([])
    keys = df.select(F.col(key).alias("k"), F.xxhash64(key).alias("h")).where("k is not null")
    some = keys.orderBy("h", "k").limit(SAMPLE).collect()
    found = sorted(r.k for r in some)
    outer = min(WIDE, wanted)
    step = len(found) / outer
    cuts = sorted({found[int(step * i)] for i in range(1, outer)}) if found else []
    if wanted <= WIDE or len(some) < SAMPLE:
        return Ranges(cuts)
    each = -(-wanted // WIDE)
    share = (some[-1].h + HASHES // 2) * each * WIDE * PER_RANGE // SAMPLE  # the SAMPLE smallest hashes tell how dense they lie
    dense = keys.where(F.col("h") <= min(share - HASHES // 2, HASHES // 2 - 1)).withColumn("__outer", bucket_of(F.col("k"), cuts))
    if dict(keys.dtypes)["k"] in ("binary", "string"):
        dense = dense.withColumn("k", F.substring("k", 1, CUT_BYTES))
    held = dense.groupBy("__outer").agg(F.sort_array(F.collect_set("k")).alias("k"))  # some each * PER_RANGE keys a row
    inside = F.transform(F.sequence(F.lit(1), F.lit(each - 1)), lambda i: F.get("k", F.floor(F.size("k") * i / each).cast("int")))
    place = scratch(df.sparkSession, "ranges")
    held.select("__outer", F.array_sort(F.array_distinct(inside)).alias("__cuts")).write.parquet(place)
    return Ranges(cuts, each, df.sparkSession.read.parquet(place))


def with_neighbours(df: DataFrame, key: str = "key", buckets: int | None = None) -> DataFrame:
    """df with prev_key and next_key, the keys before and behind each row's; keys are unique."""
    by = ranges(df, key, buckets)
    rows = by.put(df, key)
    edges = rows.groupBy("__bucket").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    order = Window.orderBy("__bucket")  # a row for each range
    carried = edges.select("__bucket", F.lag("hi").over(order).alias("__before"), F.lead("lo").over(order).alias("__behind"))
    inside = Window.partitionBy("__bucket").orderBy(key)
    joined = rows.withColumn("prev_key", F.lag(key).over(inside)).withColumn("next_key", F.lead(key).over(inside)).join(by.few(carried), "__bucket", "left")
    return joined.withColumn("prev_key", F.coalesce("prev_key", "__before")).withColumn("next_key", F.coalesce("next_key", "__behind")).drop("__bucket", "__before", "__behind")


def with_index(df: DataFrame, key: str = "key", name: str = "index", buckets: int | None = None, descending: bool = False) -> DataFrame:
    """df with each row's place in key order, from 0."""
    by = ranges(df, key, buckets)
    rows = by.put(df, key)
    side = F.desc if descending else F.asc
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(side("__bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = counts.select("__bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__bucket").orderBy(side(key))
    joined = rows.withColumn("__nth", F.row_number().over(inside) - 1).join(by.few(carried), "__bucket", "left")
    return joined.withColumn(name, F.col("__first") + F.col("__nth")).drop("__bucket", "__first", "__nth")


def as_of(probes: DataFrame, table: DataFrame, at_or_below: bool, buckets: int | None = None) -> DataFrame:
    """(probe, key, val): for each distinct probe the entry with the largest key at or below it, or the smallest at or above it; nulls if there is none.

    probes: a column probe; table: entries with unique keys. Both are cut at the same boundaries, so that a
    probe and its entry are in one bucket, but for entries that stand in one before or behind, which are carried.
    """
    by = ranges(table, "key", buckets)
    has = table.select(F.col("key").alias("at"), F.struct("key", "val").alias("e"), F.lit(0).alias("side"))
    asks = probes.select(F.col("probe").alias("at")).where("at is not null").distinct().select("at", F.lit(None).cast(has.schema["e"].dataType).alias("e"), F.lit(1).alias("side"))
    both = by.put(has.unionByName(asks), "at")
    nearest = F.max if at_or_below else F.min
    edges = by.put(has, "at").groupBy("__bucket").agg(nearest("e").alias("edge"))
    every = edges.sparkSession.range(by.count).select(F.col("id").cast("int").alias("__bucket"))
    order = Window.orderBy(F.asc("__bucket") if at_or_below else F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = every.join(edges, "__bucket", "left").select("__bucket", F.last("edge", ignorenulls=True).over(order).alias("__edge"))
    inside = Window.partitionBy("__bucket").orderBy(F.asc("at") if at_or_below else F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("f", F.last("e", ignorenulls=True).over(inside)).where("e is null").join(by.few(carried), "__bucket", "left")
    best = F.coalesce("f", "__edge")
    return found.select(F.col("at").alias("probe"), best["key"].alias("key"), best["val"].alias("val"))
