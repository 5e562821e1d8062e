"""Mixing sources to target weights.

The documents of a source, in a pseudorandom but fixed order, are one run of words, packed into blocks of BLOCK
words. The output is a run of slots in shards. For each shard a multinomial draw says how many slots each source
gets; what the draws of all shards give a source above its quota is handed to sources below theirs. Slot i of a
source reads block permutation(i), a keyed permutation of the source's full blocks, epoch after epoch; its short
last block comes at an epoch's end, and the last slot stops at the word where the quota is met. Slots and blocks
are joined by the blocks' index.

Word offsets inside a source are found without putting a source in one task: rows are dealt to BUCKETS hash
buckets of a source, bucket sums give the buckets' offsets, and a window inside a bucket gives those of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakv.llm.common import BLANK_CLASS, cut, lean, word_count

#: Words of a block.
BLOCK = 256
#: Slots of an output shard, at least; there are MAX_SHARDS shards at most.
SLOTS = 4096
MAX_SHARDS = 65_536
#: Slots that one task fills.
SLOTS_A_TASK = 2_000_000
#: Sources, at most: what is kept for each of them on the driver and in every task is of this size. More raise an error.
MAX_SOURCES = 65_536
BUCKETS = 1024
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words for each source: shares of share * sum(sizes) by the repeating weights, none over cap times its size; what is cut off goes to the others by weight."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(weight[k] for k in free)
        full = [k for k in free if unit * weight[k] >= cap * sizes[k]]
        for k in full or free:
            out[k] = cap * sizes[k] if full else unit * weight[k]
        if not full:
            break
        left -= sum(out[k] for k in full)
        free = [k for k in free if k not in set(full)]
    return out


@dataclass(frozen=True)
class Plan:
    """Per source, by index: words, quota of words, full blocks, words of the short last block, slots."""

    size: np.ndarray
    quota: np.ndarray
    full: np.ndarray
    short: np.ndarray
    slots: np.ndarray
    seed: int
    least: int

    @staticmethod
    def of(sizes: list[int], wanted: list[float], seed: int) -> Plan:
        size = np.array(sizes, dtype=np.int64)
        quota = np.minimum(np.rint(np.array(wanted)).astype(np.int64), (CAP * size).astype(np.int64))
        full, short = size // BLOCK, size % BLOCK
        some = np.maximum(size, 1)
        epochs, rest = quota // some, quota % some
        slots = epochs * (full + (short > 0)) + np.minimum(-(-rest // BLOCK), full + (rest > full * BLOCK))
        return Plan(size, quota, full, short, slots, seed, SLOTS)

    @property
    def per_shard(self) -> int:
        return max(self.least, -(-int(self.slots.sum()) // MAX_SHARDS))

    @property
    def shards(self) -> int:
        return -(-int(self.slots.sum()) // self.per_shard)

    def draw(self, shard: int) -> np.ndarray:
        """Slots of each source in a shard."""
        total = int(self.slots.sum())
        mine = min(self.per_shard, total - shard * self.per_shard)
        return np.random.default_rng([self.seed, shard]).multinomial(mine, self.slots / total)

    def settle(self, source: int, index: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(source, index) of slots: those above a source's quota become the missing ones of other sources. drawn: slots of each source over all shards."""
        spare, lack = np.maximum(drawn - self.slots, 0), np.maximum(self.slots - drawn, 0)
        sources = np.full(len(index), source)
        over = index >= self.slots[source]
        nth = index[over] - self.slots[source] + spare[:source].sum()
        ends = np.cumsum(lack)
        to = np.searchsorted(ends, nth, side="right")
        sources[over], index = to, index.copy()
        index[over] = drawn[to] + nth - (ends[to] - lack[to])
        return sources, index

    def blocks(self, source: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(epoch, block, words taken from its start) of a source's slots."""
        full, short = int(self.full[source]), int(self.short[source])
        per_epoch = full + (short > 0)
        epoch, at = index // per_epoch, index % per_epoch
        block, last = np.where(at < full, 0, full), self.quota[source] // self.size[source]
        for e in np.unique(epoch):
            pick = np.flatnonzero((epoch == e) & (at < full))
            block[pick] = permuted(at[pick], full, hash_of(self.seed, source, int(e)))
        words = np.where(at < full, BLOCK, short)
        rest = self.quota[source] % self.size[source] - at * BLOCK
        return epoch, block, np.where(epoch == last, np.minimum(words, rest), words)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_of(*parts: int) -> int:
    x = np.zeros(1, dtype=np.uint64)
    for p in parts:
        x = mixed(x + np.uint64(0x9E3779B97F4A7C15) + np.uint64(p & ((1 << 64) - 1)))
    return int(x[0])


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at each index: four Feistel rounds, walked until the value is below n."""
    if n <= 1:
        return np.zeros_like(index)
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right + np.uint64(hash_of(key, r))) & mask)
        x[todo] = left << half | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


# ---------------------------------------------------------------- distributed


@dataclass
class Mix:
    """rows: (doc_id, key, size, h, bucket) of every document; sources: (key, source, source_ix, source_size, target); offsets: (key, bucket, bucket_start). key is the source, never null."""

    rows: DataFrame
    sources: DataFrame
    offsets: DataFrame
    plan: Plan


def rows_of(docs: DataFrame, *keep: Column) -> DataFrame:
    h = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(*keep, F.col("doc_id"), key.alias("key"), word_count(F.col("text")).alias("size"), h.alias("h")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int"))


def prepare(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 1) -> Mix:
    spark: SparkSession = docs.sparkSession
    rows = cut(rows_of(docs))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    by_bucket = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.withColumn("bucket_start", F.coalesce(F.sum("n").over(by_bucket), F.lit(0))).select("key", "bucket", "bucket_start", "n"))
    found = offsets.groupBy("key").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.key == "", r.key))
    sizes = [r.n for r in found]
    wanted = targets(sizes, weights, share)
    shape = "key string, source string, source_ix int, source_size long, target double"
    sources = spark.createDataFrame([(r.key, r.key[1:] if r.key else None, k, r.n, float(t)) for k, (r, t) in enumerate(zip(found, wanted, strict=True))], shape)
    return Mix(rows, sources, offsets.drop("n"), Plan.of(sizes, wanted, seed))


def placed(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows with source_ix and start, the offset of its first word in its source. Order hangs on the rows' content alone."""
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(mix.offsets, ["key", "bucket"])
    joined = joined.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    few = F.broadcast(mix.sources.select("key", "source_ix"))  # MAX_SOURCES rows at most
    return joined.join(few, "key").drop("key", "bucket_start", "h", "bucket")


def slots(mix: Mix) -> DataFrame:
    """(shard, place, source_ix, block, epoch, take): the output's slots; place orders the slots of a shard, take is the words read from the block's start."""
    plan, spark = mix.plan, mix.rows.sparkSession
    shape = "shard int, place long, source_ix int, block long, epoch int, take int"
    if not plan.shards:
        return spark.createDataFrame([], shape)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = plan.draw(shard)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], names=["shard", "source_ix", "drawn"])

    draws = cut(spark.range(plan.shards).mapInArrow(lean(draw), "shard int, source_ix int, drawn long"))
    drawn = np.zeros(len(plan.size), dtype=np.int64)
    for r in draws.groupBy("source_ix").agg(F.sum("drawn").alias("n")).collect():
        drawn[r.source_ix] = r.n
    before = Window.partitionBy("source_ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = draws.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, source, count, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, count, 1 << 18):
                    index = np.arange(first + at, first + min(count, at + (1 << 18)))
                    own, index = plan.settle(source, index, drawn)
                    for s in np.unique(own):
                        epoch, block, take = plan.blocks(int(s), index[own == s])
                        place = mixed(index[own == s].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(hash_of(plan.seed, shard, int(s)))).view(np.int64)
                        n = len(block)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, dtype=np.int32)), pa.array(place), pa.array(np.full(n, s, dtype=np.int32)), pa.array(block), pa.array(epoch.astype(np.int32)), pa.array(take.astype(np.int32))], names=["shard", "place", "source_ix", "block", "epoch", "take"])

    # a few rows become many: dealt out by count, for their bytes would put them in one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(plan.slots.sum()) // SLOTS_A_TASK))
    begun = begun.select("shard", "source_ix", "drawn", "first").repartition(min(tasks, plan.shards), "shard")
    return begun.mapInArrow(lean(fill), shape)


def pieces(rows: DataFrame, *keep: str) -> DataFrame:
    """(source_ix, block, start, skip, words, first): what each document puts into each block: `words` words from `skip` on, from its own word `first` on."""
    end = F.col("start") + F.col("size")
    spread = rows.where("size > 0").select("source_ix", "start", "size", *keep, F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(end, (F.col("block") + 1) * BLOCK)
    return spread.select("source_ix", "block", "start", "size", *keep, (low - F.col("block") * BLOCK).alias("skip"), (high - low).alias("words"), (low - F.col("start")).alias("first"))


def used(take: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("words"), take - F.col("skip"))).cast("long")


def allotted(mix: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row for each document row; empty and null texts have size and taken 0."""
    rows = placed(mix.rows, mix)
    takes = slots(mix).groupBy("source_ix", "block").agg(F.max("take").alias("most"), F.sum("take").alias("all"))  # two epochs at most
    joined = pieces(rows, "doc_id").join(takes.hint("merge"), ["source_ix", "block"], "left")  # Spark takes slots for as few as draws, and would broadcast them
    words = F.when(F.col("most").isNull(), 0).otherwise(used(F.col("most")) + used(F.col("all") - F.col("most")))
    taken = joined.groupBy("source_ix", "start", "size", "doc_id").agg(F.sum(words).cast("long").alias("taken"))
    few = F.broadcast(mix.sources)  # MAX_SOURCES rows at most
    none = rows.where("size = 0").select("source_ix", "start", "size", "doc_id", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).join(few, "source_ix").select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 1) -> DataFrame:
    """allotted() of docs (doc_id, text, source). Null texts have no words, a null source is a source of its own, and comes last."""
    return allotted(prepare(docs, weights, share, seed))


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 1) -> DataFrame:
    """docs as the mix has them: the words that it takes of each, in order, then those that it takes again after a newline; documents of which it takes none go. n_chars, if there, is counted anew."""
    mix = prepare(docs, weights, share, seed)
    whole = placed(rows_of(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), mix).select("doc", "source_ix", "start", "size").where("size > 0")
    joined = pieces(placed(mix.rows, mix)).join(slots(mix).select("source_ix", "block", "epoch", "take").hint("merge"), ["source_ix", "block"])
    spans = joined.withColumn("n", used(F.col("take"))).where("n > 0").groupBy("source_ix", "start").agg(F.sort_array(F.collect_list(F.struct("epoch", F.col("first").cast("int").alias("first"), F.col("n").cast("int").alias("n")))).alias("spans"))
    parts = F.regexp_extract_all(F.col("doc.text"), F.lit(f"{BLANK_CLASS}*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    kept = whole.join(spans, ["source_ix", "start"]).withColumn("parts", parts)

    def epoch(k: int) -> Column:
        mine = F.filter("spans", lambda s: s["epoch"] == k)
        words = F.aggregate(mine, F.lit(0), lambda a, s: a + s["n"])
        text = F.array_join(F.transform(mine, lambda s: F.array_join(F.slice("parts", s["first"] + 1, s["n"]), "")), "")
        return F.when(words == F.col("size"), F.col("doc.text")).when(words > 0, text)

    kept = kept.withColumn("mixed", F.concat_ws("\n", epoch(0), epoch(1), epoch(2)))
    special = {"text": F.col("mixed"), "n_chars": F.char_length("mixed").cast("long")}
    return kept.select(*[special.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
