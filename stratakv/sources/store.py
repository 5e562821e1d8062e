"""Sorted immutable datasets: Parquet that is range-partitioned and sorted by key, with a block index.

`path/part-*` hold the entries, `path/_index` (file, block, first_key, last_key, rows) the blocks' ends, and
`path/_meta` one row of what the writer was told and counted. Readers of plain Parquet see the entries only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.errors import InvalidFormatVersion, OrderError
from stratakv.model import KV, UNBOUNDED, Bound
from stratakv.operators import cursor, scans
from stratakv.plans.ranged import with_index, with_neighbours
from stratakv.plans.scratch import scratch
from stratakv.sources.codecs import Codec

FORMAT_VERSION = 2
#: Entries of a block of the index.
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class WriterBuilder:
    """block_size is the size of a Parquet row group in bytes; index_key_interval the rows of a page, both where given; index_levels is recorded only."""

    codec: Codec = Codec.NONE
    level: int = 0
    block_size_: int | None = None
    index_key_interval_: int | None = None
    index_levels_: int = 0
    partitions_: int | None = None
    block_rows: int = BLOCK_ROWS

    def compression_type(self, codec: str | Codec) -> WriterBuilder:
        return replace(self, codec=Codec.parse(codec))

    def compression_level(self, level: int) -> WriterBuilder:
        return replace(self, level=level)

    def block_size(self, size: int) -> WriterBuilder:
        return replace(self, block_size_=max(1024, size))

    def index_key_interval(self, interval: int) -> WriterBuilder:
        if interval < 1:
            raise ValueError("an interval is 1 or more")
        return replace(self, index_key_interval_=interval)

    def index_levels(self, levels: int) -> WriterBuilder:
        if not 0 <= levels < 255:
            raise ValueError("index levels are 0 to 254")
        return replace(self, index_levels_=levels)

    def partitions(self, n: int) -> WriterBuilder:
        """Files; by default as many as Spark makes."""
        return replace(self, partitions_=n)

    def build(self, path: str) -> Writer:
        return Writer(path, self)

    def memory(self, spark: SparkSession) -> Writer:
        """A writer to a fresh place below the session's scratch folder."""
        return Writer(scratch(spark, "memory"), self)


@dataclass
class Writer:
    """insert() entries and finish(), or write() a whole DataFrame at once."""

    path: str
    options: WriterBuilder = field(default_factory=WriterBuilder)
    parts: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def builder() -> WriterBuilder:
        return WriterBuilder()

    def insert(self, entries: DataFrame) -> Writer:
        self.parts.append(entries)
        return self

    def finish(self) -> None:
        self.into_inner()

    def into_inner(self) -> Reader:
        """Writes what was inserted, an empty dataset for nothing. Keys have to be unique over all of it: a repeated key raises OrderError. If all parts have a column seq, keys have to ascend in its order too."""
        if not self.parts:
            return self.write(SparkSession.active().createDataFrame([], KV))
        all_of = self.parts[0]
        for p in self.parts[1:]:
            all_of = all_of.unionByName(p)
        return self.write(all_of, sorted_input=False, strict=True)

    def write(self, entries: DataFrame, sorted_input: bool = False, strict: bool = False) -> Reader:
        """sorted_input: rows are range-partitioned and sorted already. strict: check that keys are unique, and ascend by the column seq if there is one, before anything is written."""
        spark, o = entries.sparkSession, self.options
        rows = entries.select("key", "val")
        if strict:
            check_unique(rows)
            if "seq" in entries.columns:
                check_ascending(entries)
        if not sorted_input:
            rows = (rows.repartitionByRange(o.partitions_, "key") if o.partitions_ else rows.repartitionByRange("key")).sortWithinPartitions("key")
        settings = {"compression": o.codec.parquet} | o.codec.level_options(o.level)
        if o.block_size_:
            settings["parquet.block.size"] = str(o.block_size_)
        if o.index_key_interval_:
            settings["parquet.page.row.count.limit"] = str(o.index_key_interval_)
        rows.write.mode("errorifexists").options(**settings).parquet(self.path)
        written = spark.read.parquet(self.path).select("key", F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / o.block_rows).alias("block"))
        index = written.groupBy("file", "block").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("rows"))
        index.sort("last_key").write.parquet(f"{self.path}/_index")
        total = spark.read.parquet(f"{self.path}/_index").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
        meta = [(FORMAT_VERSION, o.codec.label, total, o.index_levels_, o.block_size_, o.index_key_interval_, o.block_rows)]
        spark.createDataFrame(meta, "format_version int, compression string, entries long, index_levels int, block_size long, index_key_interval long, block_rows int").coalesce(1).write.parquet(f"{self.path}/_meta")
        return Reader.open(spark, self.path)


def repeats(rows: DataFrame) -> DataFrame:
    """(key, count) of keys that a strict writer rejects: null ones, and those that stand there more than once."""
    return rows.groupBy("key").count().where("key is null or count > 1")


def check_unique(rows: DataFrame) -> None:
    """Raises OrderError for a null or repeated key."""
    bad = repeats(rows).select("key").limit(1).collect()
    if bad:
        raise OrderError(f"key {bad[0].key!r} is null or stands there more than once")


def check_ascending(rows: DataFrame, seq: str = "seq") -> None:
    """Raises OrderError unless keys strictly ascend in the order of seq."""
    walked = with_neighbours(rows.select(F.col(seq).alias("key"), F.struct("key").alias("k")))
    behind = rows.select(F.col(seq).alias("next_key"), F.col("key").alias("follower"))
    if walked.join(behind, "next_key").where(F.col("follower") <= F.col("k.key")).limit(1).collect():
        raise OrderError("keys do not strictly ascend")


@dataclass(frozen=True)
class Meta:
    format_version: int
    compression: str
    entries: int
    index_levels: int
    block_size: int | None
    index_key_interval: int | None
    block_rows: int = BLOCK_ROWS


@dataclass(frozen=True)
class Reader:
    """A handle on a dataset. Scans are DataFrames; moves are DataFrames of no row or one."""

    spark: SparkSession
    path: str
    meta: Meta

    @staticmethod
    def open(spark: SparkSession, path: str) -> Reader:
        meta = Meta(**spark.read.parquet(f"{path}/_meta").first().asDict())
        if meta.format_version not in (1, FORMAT_VERSION):
            raise InvalidFormatVersion(f"format version {meta.format_version}")
        Codec.parse(meta.compression)
        return Reader(spark, path, meta)

    @property
    def entries(self) -> DataFrame:
        """(key, val) in no order."""
        return self.spark.read.parquet(self.path).select("key", "val")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/_index")

    def file_version(self) -> int:
        return self.meta.format_version

    def compression_type(self) -> Codec:
        return Codec.parse(self.meta.compression)

    def __len__(self) -> int:
        return self.meta.entries

    def is_empty(self) -> bool:
        return self.meta.entries == 0

    def into_inner(self) -> str:
        return self.path

    get_ref = into_inner

    def into_cursor(self) -> DataFrame:
        """All entries by key."""
        return self.entries.orderBy("key")

    def cursor(self) -> Cursor:
        """A position in the dataset, for programs that step through it. Each step is a Spark job: for many steps use the scans and the batch moves."""
        return Cursor(self)

    def into_range_iter(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
        return scans.range_scan(self.entries, start, end)

    def into_rev_range_iter(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
        return scans.rev_range_scan(self.entries, start, end)

    def into_prefix_iter(self, prefix: bytes) -> DataFrame:
        return scans.prefix_scan(self.entries, prefix)

    def into_rev_prefix_iter(self, prefix: bytes) -> DataFrame:
        return scans.rev_prefix_scan(self.entries, prefix)

    def move_on_first(self) -> DataFrame:
        return cursor.at_or_above(self.entries, self._end("first_key", F.min), self.index) if len(self) else self.entries

    def move_on_last(self) -> DataFrame:
        return cursor.at_or_below(self.entries, self._end("last_key", F.max), self.index) if len(self) else self.entries

    def _end(self, name: str, of: Any) -> Any:
        return self.index.agg(of(name).alias("k")).first().k

    def move_on_next(self, key: Any = None) -> DataFrame:
        return self.move_on_first() if key is None else cursor.after(self.entries, key, self.index)

    def move_on_prev(self, key: Any = None) -> DataFrame:
        return self.move_on_last() if key is None else cursor.before(self.entries, key, self.index)

    def move_on_key_greater_than_or_equal_to(self, key: Any) -> DataFrame:
        return cursor.at_or_above(self.entries, key, self.index)

    def move_on_key_lower_than_or_equal_to(self, key: Any) -> DataFrame:
        return cursor.at_or_below(self.entries, key, self.index)

    def move_on_key_equal_to(self, key: Any) -> DataFrame:
        return cursor.equal_to(self.entries, key)

    def walk(self) -> DataFrame:
        return cursor.walk(self.entries)

    @property
    def placed(self) -> DataFrame:
        """(key, val, file, block, row): entries with their place in the block index, and in the file."""
        read = self.spark.read.parquet(self.path)
        row = F.col("_metadata.row_index")
        return read.select("key", "val", F.col("_metadata.file_name").alias("file"), F.floor(row / self.meta.block_rows).alias("block"), row.alias("row"))

    def seek_greater_than_or_equal_to(self, probes: DataFrame) -> DataFrame:
        """(probe, key, val) for each row of probes: the entry with the smallest key at or above it, nulls if there is none. Reads the blocks hit."""
        return cursor.at_or_above_in(probes, self.placed, self.index)

    def seek_lower_than_or_equal_to(self, probes: DataFrame) -> DataFrame:
        """The same with the largest key at or below it."""
        return cursor.at_or_below_in(probes, self.placed, self.index)

    def seek_equal_to(self, probes: DataFrame) -> DataFrame:
        """The same with the very key."""
        return cursor.equal_to_in(probes, self.placed, self.index)


@dataclass
class Cursor:
    """An entry of a dataset, or none. A move gives the entry it lands on; one that finds none gives None and leaves the cursor where it was."""

    reader: Reader
    entry: tuple[Any, Any] | None = None

    def current(self) -> tuple[Any, Any] | None:
        return self.entry

    def reset(self) -> None:
        self.entry = None

    def into_reader(self) -> Reader:
        return self.reader

    def _land(self, found: DataFrame) -> tuple[Any, Any] | None:
        rows = found.limit(1).collect()
        if not rows:
            return None
        plain = [bytes(x) if isinstance(x, bytearray) else x for x in rows[0]]
        self.entry = (plain[0], plain[1])
        return self.entry

    def move_on_first(self) -> tuple[Any, Any] | None:
        return self._land(self.reader.move_on_first())

    def move_on_last(self) -> tuple[Any, Any] | None:
        return self._land(self.reader.move_on_last())

    def move_on_next(self) -> tuple[Any, Any] | None:
        """The entry behind the current one; the first if there is none."""
        return self._land(self.reader.move_on_next(self.entry and self.entry[0]))

    def move_on_prev(self) -> tuple[Any, Any] | None:
        """The entry before the current one; the last if there is none."""
        return self._land(self.reader.move_on_prev(self.entry and self.entry[0]))

    def move_on_key_lower_than_or_equal_to(self, key: Any) -> tuple[Any, Any] | None:
        return self._land(self.reader.move_on_key_lower_than_or_equal_to(key))

    def move_on_key_greater_than_or_equal_to(self, key: Any) -> tuple[Any, Any] | None:
        return self._land(self.reader.move_on_key_greater_than_or_equal_to(key))

    def move_on_key_equal_to(self, key: Any) -> tuple[Any, Any] | None:
        return self._land(self.reader.move_on_key_equal_to(key))


def block_index(entries: DataFrame, interval: int) -> DataFrame:
    """(block, last_key, rows): the sparse index of entries by blocks of `interval` keys."""
    placed = with_index(entries.select("key"), "key", "nth")
    return placed.groupBy(F.floor(F.col("nth") / interval).alias("block")).agg(F.max("key").alias("last_key"), F.count(F.lit(1)).alias("rows"))


