"""Sorter: unordered entries in, sorted ones out, one for each key, values folded by a merge function.

Spark sorts, spills and merges by itself, so what a sorter adds is the plan: which values meet in which order,
and one shuffle where one is enough. A stable sorter keeps the order of arrival by (chunk, seq), an unstable
one does without, and its aggregates combine before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.errors import MergeError
from stratakv.functions.merge import Merge, MergeUdf
from stratakv.model import KV
from stratakv.sources.codecs import Codec

if TYPE_CHECKING:
    from stratakv.sources.store import Reader, Writer

STABLE, UNSTABLE = "stable", "unstable"
LEAST_MEMORY = 10 << 20
#: What each entry is taken to cost besides its bytes.
ENTRY_OVERHEAD = 16


#: Values of one key by which a Python merge function folds first, as a power of two: those whose seq differs in lower bits only.
RUN_BITS = 12


def fold(rows: DataFrame, merge: Merge, order: str | None, *by: str) -> DataFrame:
    """(*by, key, val): one row for each key of rows (key, val, and the order column, a struct that ends in seq, if named).

    A Python merge function folds runs of a key's values first, then what these gave, in their order: so no row holds
    all values of a key, but for a seq that repeats. Without an order a run is what one task has of a key.
    """
    if isinstance(merge, MergeUdf):
        if order:
            kinds = {f.name: f.dataType for f in rows.schema[order].dataType.fields}
            cut = F.shiftright(F.col(f"{order}.seq"), RUN_BITS) if isinstance(kinds["seq"], T.IntegralType) else F.lit(0)
            run = F.struct(*[F.col(f"{order}.{f}") for f in kinds if f != "seq"], cut.alias("seq"))
        else:
            run = F.struct(F.spark_partition_id().alias("seq"))
        runs = rows.withColumn("__run", run)
        folded = merge.aggregate(F.col("val"), F.col(order) if order else None)
        rows = runs.groupBy(*by, "key", "__run").agg(folded.alias("val")).select(*by, "key", "__run", merge.finish(F.col("key"), F.col("val")).alias("val"))
        order = "__run"
    folded = merge.aggregate(F.col("val"), F.col(order) if order else None)
    return rows.groupBy(*by, "key").agg(folded.alias("val")).select(*by, "key", merge.finish(F.col("key"), F.col("val"), again=order == "__run").alias("val"))


def empty(*more: str) -> DataFrame:
    """No entries."""
    return SparkSession.active().createDataFrame([], KV).select(*[F.lit(None).cast("int").alias(m) for m in more], "key", "val")


@dataclass(frozen=True)
class SorterBuilder:
    """Options. Those that a Spark session decides (memory, buffers, number and place of chunks, threads, blocks of chunks) are kept, checked and shown, and have no other effect."""

    merge: Merge
    dump_threshold_: int = 1 << 30
    allow_realloc_: bool = True
    max_nb_chunks_: int = 25
    codec: Codec = Codec.NONE
    level: int = 0
    index_key_interval_: int = 8
    block_size_: int = 8192
    index_levels_: int = 0
    algorithm: str = STABLE
    parallel: bool = False
    chunk_creator_: object = None

    def dump_threshold(self, memory: int) -> SorterBuilder:
        return replace(self, dump_threshold_=max(LEAST_MEMORY, memory))

    def allow_realloc(self, allow: bool) -> SorterBuilder:
        return replace(self, allow_realloc_=allow)

    def max_nb_chunks(self, chunks: int) -> SorterBuilder:
        return replace(self, max_nb_chunks_=max(1, chunks))

    def chunk_compression_type(self, codec: str | Codec) -> SorterBuilder:
        return replace(self, codec=Codec.parse(codec))

    def chunk_compression_level(self, level: int) -> SorterBuilder:
        return replace(self, level=level)

    def index_key_interval(self, interval: int) -> SorterBuilder:
        if interval < 1:
            raise ValueError("an interval is 1 or more")
        return replace(self, index_key_interval_=interval)

    def block_size(self, size: int) -> SorterBuilder:
        return replace(self, block_size_=max(1024, size))

    def index_levels(self, levels: int) -> SorterBuilder:
        return replace(self, index_levels_=levels)

    def sort_algorithm(self, algorithm: str) -> SorterBuilder:
        if algorithm not in (STABLE, UNSTABLE):
            raise ValueError(f"no sort algorithm is named {algorithm!r}")
        return replace(self, algorithm=algorithm)

    def sort_in_parallel(self, parallel: bool) -> SorterBuilder:
        return replace(self, parallel=parallel)

    def chunk_creator(self, creator: object) -> SorterBuilder:
        return replace(self, chunk_creator_=creator)

    def build(self) -> Sorter:
        return Sorter(self)


@dataclass
class Sorter:
    """insert() entries, each DataFrame a chunk of its own; then read or write the result once or more often."""

    options: SorterBuilder
    chunks: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def builder(merge: Merge) -> SorterBuilder:
        return SorterBuilder(merge)

    @staticmethod
    def new(merge: Merge) -> Sorter:
        return Sorter(SorterBuilder(merge))

    @property
    def stable(self) -> bool:
        return self.options.algorithm == STABLE

    def insert(self, entries: DataFrame) -> Sorter:
        """entries: key, val, and for a stable sorter of an ordered merge also seq, their order of arrival in the chunk."""
        if self.stable and self.options.merge.ordered and "seq" not in entries.columns:
            raise MergeError(f"{self.options.merge.name} needs a column seq, the order of arrival")
        if self.chunks and ("seq" in entries.columns) != ("seq" in self.chunks[0].columns):
            raise MergeError("all chunks have a column seq, or none")
        self.chunks.append(entries)
        return self

    def rows(self) -> DataFrame:
        """(chunk_id, key, val, ord) of all chunks, one at least."""
        tagged = []
        for k, c in enumerate(self.chunks):
            seq = F.col("seq") if "seq" in c.columns else F.lit(None).cast("long")
            tagged.append(c.select(F.lit(k).alias("chunk_id"), "key", "val", F.struct(F.lit(k).alias("chunk_id"), seq.alias("seq")).alias("ord")))
        return reduce(DataFrame.unionByName, tagged)

    @property
    def order(self) -> str | None:
        return "ord" if self.stable and "seq" in self.chunks[0].columns or self.options.merge.ordered else None

    def merged(self) -> DataFrame:
        """(key, val), in no order; binary and empty if nothing was inserted."""
        return fold(self.rows(), self.options.merge, self.order) if self.chunks else empty()

    def into_stream_merger_iter(self) -> DataFrame:
        """(key, val) by key; toLocalIterator() pulls them.

        Values of an ordered merge, which nothing can combine before they move, are dealt out by ranges of keys at once, and
        so are sorted by it without a second shuffle.
        """
        if self.chunks and self.options.merge.ordered and not isinstance(self.options.merge, MergeUdf):
            return fold(self.rows().repartitionByRange("key"), self.options.merge, self.order).orderBy("key")
        return self.merged().orderBy("key")

    def write_into_stream_writer(self, writer: Writer) -> Reader:
        return writer.write(self.merged(), sorted_input=False)

    def into_reader_cursors(self) -> list[DataFrame]:
        """The runs, one for each chunk, sorted and folded in themselves but not with each other."""
        runs = self.per_run()
        return [runs.where(F.col("chunk_id") == k).select("key", "val").orderBy("key") for k in range(len(self.chunks))]

    def per_run(self) -> DataFrame:
        """(chunk_id, key, val): all runs in one DataFrame."""
        return fold(self.rows(), self.options.merge, self.order, "chunk_id") if self.chunks else empty("chunk_id")

    def estimated_dumped_memory_usage(self) -> DataFrame:
        """One row, bytes: an upper estimate of what the entries take."""
        if not self.chunks:
            return empty().agg(F.count(F.lit(1)).alias("bytes"))
        size = F.octet_length("key") + F.coalesce(F.octet_length(F.col("val").cast("binary")) if dict(self.chunks[0].dtypes)["val"] in ("string", "binary") else F.lit(8), F.lit(0)) + ENTRY_OVERHEAD
        return self.rows().agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))

    def __repr__(self) -> str:
        o = self.options
        return f"Sorter(merge={o.merge.name}, algorithm={o.algorithm}, chunks={len(self.chunks)}, dump_threshold={o.dump_threshold_}, max_nb_chunks={o.max_nb_chunks_}, codec={o.codec.label})"
