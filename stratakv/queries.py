"""Queries of the key-value operators, (spark, sf_dir) -> DataFrame, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.errors import OrderError
from stratakv.functions import keys, merge
from stratakv.functions.merge import CONCAT, COUNT, FIRST, LAST, MAX, MIN, SET_UNION, SUM, SUM_U32, Merge
from stratakv.model import UNBOUNDED, Bound, excluded, included
from stratakv.operators import cursor, scans
from stratakv.operators.merger import Merger
from stratakv.operators.sorter import UNSTABLE, Sorter
from stratakv.plans.ranged import with_index
from stratakv.plans.scratch import scratch
from stratakv.sources import blockfile
from stratakv.sources.codecs import Codec
from stratakv.sources.store import Reader, Writer, block_index, repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as entries: part key, whole quantity."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("val"))


def happenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as entries in order of arrival: user, type, event id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("val"), F.col("event_id").alias("seq"))


def order_keys(spark: SparkSession, sf_dir: str, plus: int = 0) -> DataFrame:
    """orders as binary entries: 8-byte key, priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(keys.be_u64(F.col("o_orderkey") + plus).alias("key"), keys.utf8(F.col("o_orderpriority")).alias("val"), "o_orderkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("val"))


# ---------------------------------------------------------------- sorter


@query("SELECT l_partkey AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) % 4294967296 AS BIGINT) AS val FROM lineitem GROUP BY 1")
def sorter_sum_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sorter.new(SUM_U32).insert(quantities(spark, sf_dir)).into_stream_merger_iter()


@query("SELECT upper(printf('%016X', l_partkey)) AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1")
def sorter_binary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantities(spark, sf_dir).select(keys.be_u64(F.col("key")).alias("key"), "val")
    return Sorter.new(SUM).insert(rows).into_stream_merger_iter().select(F.hex("key").alias("key"), "val")


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS val FROM events GROUP BY 1")
def sorter_concat_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sorter.new(CONCAT).insert(happenings(spark, sf_dir)).into_stream_merger_iter()


@query("SELECT user_id AS key, arg_min(event_type, event_id) AS val FROM events GROUP BY 1")
def sorter_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sorter.new(FIRST).insert(happenings(spark, sf_dir)).into_stream_merger_iter()


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS val FROM events GROUP BY 1")
def sorter_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sorter.new(LAST).insert(happenings(spark, sf_dir)).into_stream_merger_iter()


@query("SELECT l_partkey AS key, min(CAST(trunc(l_quantity) AS BIGINT)) AS lo, max(CAST(trunc(l_quantity) AS BIGINT)) AS hi, count(*) AS n FROM lineitem GROUP BY 1")
def sorter_min_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three unstable sorters over one input as one aggregate."""
    rows = quantities(spark, sf_dir)
    one = F.lit(1).cast("long")
    return rows.groupBy("key").agg(MIN.aggregate(F.col("val"), None).alias("lo"), MAX.aggregate(F.col("val"), None).alias("hi"), COUNT.aggregate(one, None).alias("n")).orderBy("key")


@query("SELECT user_id AS key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS val FROM events GROUP BY 1")
def sorter_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sorter.builder(SET_UNION).sort_algorithm(UNSTABLE).build().insert(happenings(spark, sf_dir).drop("seq")).into_stream_merger_iter()


@query("SELECT l_partkey AS key, bit_or(CAST(trunc(l_quantity) AS BIGINT)) AS val FROM lineitem GROUP BY 1")
def sorter_bit_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sorter.builder(merge.BIT_OR).sort_algorithm(UNSTABLE).build().insert(quantities(spark, sf_dir)).into_stream_merger_iter()


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS val FROM events GROUP BY 1")
def sorter_merge_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge function in Python over each key's bytes."""
    rows = happenings(spark, sf_dir).withColumn("val", keys.utf8(F.col("val")))
    joined = merge.udf(lambda key, values: b"".join(values), "concat")
    return Sorter.new(joined).insert(rows).into_stream_merger_iter().select("key", F.decode("val", "UTF-8").alias("val"))


@query("SELECT CAST(event_id % 3 AS INTEGER) AS chunk_id, user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS val FROM events GROUP BY 1, 2")
def sorter_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks, each sorted and folded in itself."""
    sorter = Sorter.new(CONCAT)
    for k in range(3):
        sorter.insert(happenings(spark, sf_dir).where(F.col("seq") % 3 == k))
    return sorter.per_run()


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id % 3, event_id) AS val FROM events GROUP BY 1")
def sorter_chunks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three chunks, folded with each other in their order."""
    sorter = Sorter.new(CONCAT)
    for k in range(3):
        sorter.insert(happenings(spark, sf_dir).where(F.col("seq") % 3 == k))
    return sorter.into_stream_merger_iter()


@query("SELECT CAST(sum(8 + octet_length(encode(event_type)) + 16) AS BIGINT) AS bytes FROM events")
def sorter_estimated_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = happenings(spark, sf_dir).select(keys.be_u64(F.col("key")).alias("key"), keys.utf8(F.col("val")).alias("val"), "seq")
    return Sorter.new(merge.CONCAT_BYTES).insert(rows).estimated_dumped_memory_usage()


@query("SELECT user_id AS key, hex(encode(string_agg(event_type, '' ORDER BY event_id))) AS val FROM events GROUP BY 1")
def sorter_concat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = happenings(spark, sf_dir).withColumn("val", keys.utf8(F.col("val")))
    return Sorter.new(merge.CONCAT_BYTES).insert(rows).into_stream_merger_iter().select("key", F.hex("val").alias("val"))


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id % 3, event_id) AS val FROM events GROUP BY 1")
def sorter_merge_udf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python merge function over three chunks: it folds runs of a chunk, then the runs of all chunks in order."""
    sorter = Sorter.new(merge.udf(lambda key, values: b"".join(values), "concat"))
    for k in range(3):
        sorter.insert(happenings(spark, sf_dir).where(F.col("seq") % 3 == k).withColumn("val", keys.utf8(F.col("val"))))
    return sorter.into_stream_merger_iter().select("key", F.decode("val", "UTF-8").alias("val"))


@query("SELECT 1 AS chunk_id, user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS val FROM events WHERE event_id % 3 = 1 GROUP BY 2")
def sorter_reader_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of three runs, by its own cursor."""
    sorter = Sorter.new(CONCAT)
    for k in range(3):
        sorter.insert(happenings(spark, sf_dir).where(F.col("seq") % 3 == k))
    return sorter.into_reader_cursors()[1].select(F.lit(1).alias("chunk_id"), "key", "val")


NOTHING = "SELECT CAST(0 AS BIGINT) AS merged, CAST(0 AS BIGINT) AS stored FROM region LIMIT 1"


@query(NOTHING)
def sorter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorter without chunks gives no entries, and writes an empty dataset."""
    sorter = Sorter.new(SUM)
    reader = sorter.write_into_stream_writer(Writer(scratch(spark, "empty")))
    return sorter.into_stream_merger_iter().agg(F.count(F.lit(1)).alias("merged")).withColumn("stored", F.lit(len(reader)).cast("long"))


@query(NOTHING)
def merger_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merger without sources gives no entries; a writer without entries an empty dataset."""
    reader = Writer(scratch(spark, "empty")).into_inner()
    return Merger.builder(SUM).build().into_stream_merger_iter().agg(F.count(F.lit(1)).alias("merged")).withColumn("stored", F.lit(len(reader)).cast("long"))


# ---------------------------------------------------------------- merger


def parts_by(spark: SparkSession, sf_dir: str, column: str, values: list[str], fold: Merge) -> list[DataFrame]:
    """One sorted source for each value of a lineitem column."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("val"), column)
    return [Sorter.new(fold).insert(rows.where(F.col(column) == v).drop(column)).merged() for v in values]


@query("SELECT l_partkey AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1")
def merger_kway_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    merger = Merger.builder(SUM)
    merger.extend(parts_by(spark, sf_dir, "l_returnflag", ["A", "N", "R"], SUM))
    return merger.build().into_stream_merger_iter()


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id % 2 DESC, event_id) AS val FROM events GROUP BY 1")
def merger_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events are the first source, so that their values come first."""
    rows = happenings(spark, sf_dir)
    return Merger.builder(CONCAT).add(rows.where("seq % 2 = 1")).add(rows.where("seq % 2 = 0")).build().into_stream_merger_iter()


@query("SELECT l_partkey AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem WHERE l_returnflag = 'A' OR l_returnflag = 'N' AND l_partkey > 100 GROUP BY 1")
def merger_positioned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source takes part from behind key 100 on."""
    a, n = parts_by(spark, sf_dir, "l_returnflag", ["A", "N"], SUM)
    return Merger.builder(SUM).add(a).add(n, after_key=100).build().into_stream_merger_iter()


# ---------------------------------------------------------------- writer and reader


def stored(spark: SparkSession, sf_dir: str, codec: Codec = Codec.NONE, level: int = 0, plus: int = 0) -> Reader:
    writer = Writer.builder().compression_type(codec).compression_level(level).build(scratch(spark, "orders"))
    return writer.insert(order_keys(spark, sf_dir, plus).select("key", "val")).into_inner()


ROUND_TRIP = "SELECT printf('%016X', o_orderkey) AS key, o_orderpriority AS val FROM orders"


def round_trip(codec: Codec, level: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored(spark, sf_dir, codec, level).into_cursor().select(F.hex("key").alias("key"), F.decode("val", "UTF-8").alias("val"))

    return run


for _codec, _level in ((Codec.NONE, 0), (Codec.SNAPPY_PRE_05, 0), (Codec.ZLIB, 1), (Codec.LZ4, 0), (Codec.ZSTD, 3), (Codec.SNAPPY, 0)):
    query(ROUND_TRIP, "writer_reader_" + _codec.label.replace("-", "_").replace(".", "_"))(round_trip(_codec, _level))


@query(ROUND_TRIP)
def writer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options of a writer, to a fresh place below the scratch folder; the dataset is opened again by its path."""
    options = Writer.builder().compression_type("zstd").compression_level(3).block_size(4096).index_key_interval(64).index_levels(2)
    written = options.memory(spark).insert(order_keys(spark, sf_dir).select("key", "val")).into_inner()
    return Reader.open(spark, written.get_ref()).into_cursor().select(F.hex("key").alias("key"), F.decode("val", "UTF-8").alias("val"))


@query("SELECT l_partkey AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1")
def sorter_into_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    writer = Writer.builder().compression_type("zstd").build(scratch(spark, "sums"))
    return Sorter.new(SUM).insert(quantities(spark, sf_dir)).write_into_stream_writer(writer).into_cursor()


@query("SELECT l_partkey AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def merger_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored runs are merged to a third."""
    runs = [Sorter.new(SUM).insert(p).write_into_stream_writer(Writer(scratch(spark, "run"))) for p in parts_by(spark, sf_dir, "l_returnflag", ["A", "R"], SUM)]
    return Merger.builder(SUM).extend([r.entries for r in runs]).build().write_into_stream_writer(Writer(scratch(spark, "merged"))).into_cursor()


@query("SELECT l_partkey AS key, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1")
def merger_compaction_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run for each return flag, all of them merged to one."""
    flags = sorted(r.f for r in table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f")).distinct().collect())
    runs = [Sorter.new(SUM).insert(p).write_into_stream_writer(Writer(scratch(spark, "run"))) for p in parts_by(spark, sf_dir, "l_returnflag", flags, SUM)]
    return Merger.builder(SUM).extend([r.entries for r in runs]).build().write_into_stream_writer(Writer(scratch(spark, "merged"))).into_cursor()


@query("SELECT printf('%016X', o_orderkey) AS key, o_orderpriority AS val, o_orderkey BETWEEN 500 AND 2500 AS seen FROM orders")
def block_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files with two index levels, four of them, and which entries a range read of them finds."""
    place = scratch(spark, "blocks")
    blockfile.write_block_files(order_keys(spark, sf_dir), place, "snappy", block_size=1024, levels=2, partitions=4)
    some = blockfile.read_block_files(spark, place, (500).to_bytes(8, "big"), (2500).to_bytes(8, "big"))
    found = blockfile.read_block_files(spark, place).join(some.select("key", F.lit(True).alias("seen")), "key", "left")
    return found.select(F.hex("key").alias("key"), F.decode("val", "UTF-8").alias("val"), F.coalesce("seen", F.lit(False)).alias("seen"))


@query("SELECT count(*) AS entries, 2 AS version, 'zstd' AS compression FROM orders")
def block_file_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark, "blocks")
    blockfile.write_block_files(order_keys(spark, sf_dir), place, "zstd", partitions=3)
    return blockfile.footers(spark, place).groupBy("version", "compression").agg(F.sum("entries").cast("long").alias("entries"))


@query("SELECT count(*) > count(DISTINCT l_orderkey) AS repeats, true AS rejected FROM lineitem")
def writer_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict writer takes orders once, and rejects them with a line's key repeated."""
    lines = table(spark, sf_dir, "lineitem").select(keys.be_u64(F.col("l_orderkey")).alias("key"), keys.utf8(F.col("l_returnflag")).alias("val"))
    try:
        Writer(scratch(spark, "strict")).insert(lines).into_inner()
        rejected = False
    except OrderError:
        rejected = True
    return lines.agg((F.count("key") > F.count_distinct("key")).alias("repeats")).withColumn("rejected", F.lit(rejected))


@query("SELECT o_orderkey, printf('%016X', o_orderkey) AS key FROM orders")
def key_be_u64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_keys(spark, sf_dir).select("o_orderkey", F.hex("key").alias("key"))


@query("SELECT c_custkey, hex(encode(c_name)) AS key FROM customer")
def key_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(keys.utf8(F.col("c_name"))).alias("key"))


@query("SELECT o_orderkey - 5000 AS n, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def key_signed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed keys, encoded, sort as numbers do; read back by decoding."""
    rows = table(spark, sf_dir, "orders").select(keys.be_i64(F.col("o_orderkey") - 5000).alias("key"))
    return with_index(rows, "key", "i").select(keys.from_be_i64(F.col("key")).alias("n"), (F.col("i") + 1).alias("place"))


@query("SELECT count(*) AS n, count(*) = 0 AS empty, 2 AS version, 'snappy' AS compression FROM orders")
def reader_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """len, is_empty, file_version and compression_type, all from the dataset's metadata."""
    r = stored(spark, sf_dir, Codec.SNAPPY)
    return spark.createDataFrame([(len(r), r.is_empty(), r.file_version(), r.compression_type().label)], "n long, empty boolean, version int, compression string")


# ---------------------------------------------------------------- cursor


@query("SELECT o_orderkey AS key, o_orderpriority AS val FROM orders ORDER BY 1 LIMIT 1")
def cursor_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.first(orders(spark, sf_dir))


@query("SELECT o_orderkey AS key, o_orderpriority AS val FROM orders ORDER BY 1 DESC LIMIT 1")
def cursor_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.last(orders(spark, sf_dir))


@query("SELECT o_orderkey AS key, o_orderpriority AS val, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS prev_key, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_key FROM orders")
def cursor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.walk(orders(spark, sf_dir))


MOVES = """
SELECT * FROM (SELECT 'first' AS move, printf('%016X', o_orderkey) AS key FROM orders ORDER BY o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'last', printf('%016X', o_orderkey) FROM orders ORDER BY o_orderkey DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'next', printf('%016X', o_orderkey) FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'prev', printf('%016X', o_orderkey) FROM orders WHERE o_orderkey < 700 ORDER BY o_orderkey DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'ge', printf('%016X', o_orderkey) FROM orders WHERE o_orderkey >= 701 ORDER BY o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'le', printf('%016X', o_orderkey) FROM orders WHERE o_orderkey <= 99999999 ORDER BY o_orderkey DESC LIMIT 1)
UNION ALL SELECT 'eq', printf('%016X', o_orderkey) FROM orders WHERE o_orderkey = 702
"""


@query(MOVES)
def reader_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves over a stored dataset, each bounded by the block index; the moves that find nothing give no row."""
    r = stored(spark, sf_dir)

    def at(n: int) -> bytes:
        return n.to_bytes(8, "big")

    moves = {"first": r.move_on_first(), "last": r.move_on_last(), "next": r.move_on_next(at(700)), "prev": r.move_on_prev(at(700)), "ge": r.move_on_key_greater_than_or_equal_to(at(701)), "le": r.move_on_key_lower_than_or_equal_to(at(99999999)), "eq": r.move_on_key_equal_to(at(702)), "none": r.move_on_key_greater_than_or_equal_to(at(99999999))}
    out = None
    for name, df in moves.items():
        one = df.select(F.lit(name).alias("move"), F.hex("key").alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


STEPS = """
SELECT 'ge' AS step, (SELECT printf('%016X', min(o_orderkey)) FROM orders WHERE o_orderkey >= 700) AS key
UNION ALL SELECT 'next', (SELECT printf('%016X', o_orderkey) FROM orders WHERE o_orderkey >= 700 ORDER BY o_orderkey LIMIT 1 OFFSET 1)
UNION ALL SELECT 'missed', (SELECT printf('%016X', o_orderkey) FROM orders WHERE o_orderkey >= 700 ORDER BY o_orderkey LIMIT 1 OFFSET 1)
UNION ALL SELECT 'prev', (SELECT printf('%016X', min(o_orderkey)) FROM orders WHERE o_orderkey >= 700)
UNION ALL SELECT 'reset', NULL
"""


@query(STEPS)
def cursor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a position in a stored dataset stands after each of five moves."""
    c = stored(spark, sf_dir).cursor()
    moves = {"ge": lambda: c.move_on_key_greater_than_or_equal_to((700).to_bytes(8, "big")), "next": c.move_on_next, "missed": lambda: c.move_on_key_equal_to(b""), "prev": c.move_on_prev, "reset": c.reset}
    rows = []
    for name, move in moves.items():
        move()
        at = c.current()
        rows.append((name, at and at[0].hex().upper()))
    return spark.createDataFrame(rows, "step string, key string")


PROBES = "SELECT (c_custkey * 7919) % 40000 - 100 AS probe FROM customer"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.pmod(F.col("c_custkey") * 7919, F.lit(40000)) - 100).alias("probe"))


@query(f"SELECT p.probe, o.o_orderkey AS key, o.o_orderpriority AS val FROM ({PROBES}) p LEFT JOIN orders o ON o.o_orderkey = p.probe")
def seek_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.equal_to_many(probes(spark, sf_dir), orders(spark, sf_dir))


@query(f"SELECT p.probe, o.o_orderkey AS key, o.o_orderpriority AS val FROM ({PROBES}) p ASOF LEFT JOIN orders o ON p.probe >= o.o_orderkey")
def seek_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.at_or_below_many(probes(spark, sf_dir), orders(spark, sf_dir))


@query(f"SELECT p.probe, o.o_orderkey AS key, o.o_orderpriority AS val FROM ({PROBES}) p ASOF LEFT JOIN orders o ON p.probe <= o.o_orderkey")
def seek_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.at_or_above_many(probes(spark, sf_dir), orders(spark, sf_dir))


WIDE_PROBES = "SELECT (c_custkey * 7919) % (SELECT max(o_orderkey) + 200 FROM orders) - 100 AS probe FROM customer"


def sought(kind: str) -> Query:
    """Probes spread over the whole range of keys, sought in a stored dataset through its block index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("k")).first().k
        asked = table(spark, sf_dir, "customer").select((F.pmod(F.col("c_custkey") * 7919, F.lit(reach + 200)) - 100).alias("n"))
        asked = asked.select(keys.be_i64(F.col("n")).alias("probe"))
        rows = table(spark, sf_dir, "orders").select(keys.be_i64(F.col("o_orderkey")).alias("key"), keys.utf8(F.col("o_orderpriority")).alias("val"))
        r = Writer.builder().compression_type("zstd").build(scratch(spark, "orders")).insert(rows).into_inner()
        seek = {"ge": r.seek_greater_than_or_equal_to, "le": r.seek_lower_than_or_equal_to, "eq": r.seek_equal_to}[kind]
        return seek(asked).select(keys.from_be_i64(F.col("probe")).alias("probe"), keys.from_be_i64(F.col("key")).alias("key"), F.decode("val", "UTF-8").alias("val"))

    return run


for _kind, _join in (("ge", "ASOF LEFT JOIN orders o ON p.probe <= o.o_orderkey"), ("le", "ASOF LEFT JOIN orders o ON p.probe >= o.o_orderkey"), ("eq", "LEFT JOIN orders o ON o.o_orderkey = p.probe")):
    query(f"SELECT p.probe, o.o_orderkey AS key, o.o_orderpriority AS val FROM ({WIDE_PROBES}) p {_join}", f"seek_{_kind}_stored")(sought(_kind))


# ---------------------------------------------------------------- ranges and prefixes


def numbered(df: DataFrame) -> DataFrame:
    """Entries with their places in both directions, so that the order of a scan is in its rows."""
    up = with_index(df.select("key", "val"), "key", "up")
    return with_index(up, "key", "down", descending=True)


def ranged(start: Bound, end: Bound) -> Query:
    return lambda spark, sf_dir: numbered(scans.within(orders(spark, sf_dir), start, end))


LO, HI = 200, 1000
for _a, _start, _low in (("i", included(LO), f"o_orderkey >= {LO}"), ("e", excluded(LO), f"o_orderkey > {LO}"), ("u", UNBOUNDED, "true")):
    for _b, _end, _high in (("i", included(HI), f"o_orderkey <= {HI}"), ("e", excluded(HI), f"o_orderkey < {HI}"), ("u", UNBOUNDED, "true")):
        _sql = f"SELECT o_orderkey AS key, o_orderpriority AS val, row_number() OVER (ORDER BY o_orderkey) - 1 AS up, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS down FROM orders WHERE {_low} AND {_high}"
        query(_sql, f"range_{_a}{_b}")(ranged(_start, _end))
query("SELECT o_orderkey AS key, o_orderpriority AS val, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS down FROM orders WHERE false", "range_inverted")(ranged(included(HI), included(LO)))


def in_order(scan: DataFrame) -> DataFrame:
    """The rows of a scan over a fixed range, 801 keys at most, with their places in the order in which they come."""
    rows = [(n, r.key, r.val) for n, r in enumerate(scan.toLocalIterator())]
    return scan.sparkSession.createDataFrame(rows, "nth long, key long, val string")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, o_orderkey AS key, o_orderpriority AS val FROM orders WHERE o_orderkey BETWEEN {LO} AND {HI}")
def range_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(scans.range_scan(orders(spark, sf_dir), included(LO), included(HI)))


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS nth, o_orderkey AS key, o_orderpriority AS val FROM orders WHERE o_orderkey > {LO} AND o_orderkey < {HI}")
def rev_range_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(scans.rev_range_scan(orders(spark, sf_dir), excluded(LO), excluded(HI)))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, o_orderkey AS key, o_orderpriority AS val FROM orders WHERE o_orderkey BETWEEN 768 AND 1023")
def prefix_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.prefix_scan(order_keys(spark, sf_dir).select("key", "val"), bytes(6) + b"\x03")
    return in_order(decoded(found))


@query("SELECT printf('%016X', o_orderkey) AS key, o_orderpriority AS val FROM orders WHERE o_orderkey BETWEEN 300 AND 399")
def range_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a stored dataset, descending."""
    found = stored(spark, sf_dir).into_rev_range_iter(included((300).to_bytes(8, "big")), excluded((400).to_bytes(8, "big")))
    return found.select(F.hex("key").alias("key"), F.decode("val", "UTF-8").alias("val"))


def decoded(found: DataFrame) -> DataFrame:
    """Entries of order_keys() with their keys as numbers again."""
    return found.select(keys.from_be_i64(F.col("key")).bitwiseXOR(F.lit(-(1 << 63))).alias("key"), F.decode("val", "UTF-8").alias("val"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, o_orderkey AS key, o_orderpriority AS val FROM orders WHERE o_orderkey >= 300 AND o_orderkey < 400")
def range_iter_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a stored dataset, ascending, with the places of its entries in the scan."""
    return in_order(decoded(stored(spark, sf_dir).into_range_iter(included((300).to_bytes(8, "big")), excluded((400).to_bytes(8, "big")))))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, o_orderkey AS key, o_orderpriority AS val FROM orders WHERE o_orderkey BETWEEN 512 AND 767")
def prefix_iter_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(decoded(stored(spark, sf_dir).into_prefix_iter(bytes(6) + b"\x02")))


@query("SELECT p_name AS key, p_partkey AS val FROM part WHERE starts_with(p_name, 'b')")
def prefix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text keys by their bytes: the range rewrite is the same."""
    rows = table(spark, sf_dir, "part").select(keys.utf8(F.col("p_name")).alias("key"), F.col("p_partkey").alias("val"))
    return scans.with_prefix(rows, b"b").select(F.decode("key", "UTF-8").alias("key"), "val")


def prefixed(plus: int, prefix: bytes) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return numbered(scans.with_prefix(order_keys(spark, sf_dir, plus), prefix)).select(F.hex("key").alias("key"), F.decode("val", "UTF-8").alias("val"), "up", "down")

    shown = f"printf('%016X', o_orderkey + {plus})"
    return run, f"SELECT {shown} AS key, o_orderpriority AS val, row_number() OVER (ORDER BY o_orderkey) - 1 AS up, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS down FROM orders WHERE starts_with({shown}, '{prefix.hex().upper()}')"


for _name, _plus, _prefix in (("prefix_bin", 0, bytes(6) + b"\x03"), ("prefix_ff", 65000, bytes(6) + b"\xff"), ("prefix_empty", 0, b""), ("prefix_whole_key", 0, (77).to_bytes(8, "big"))):
    _run, _sql = prefixed(_plus, _prefix)
    query(_sql, _name)(_run)


@query("SELECT printf('%016X', o_orderkey + 65000) AS key FROM orders WHERE starts_with(printf('%016X', o_orderkey + 65000), '000000000000FF')")
def prefix_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, plus=65000).into_rev_prefix_iter(bytes(6) + b"\xff").select(F.hex("key").alias("key"))


# ---------------------------------------------------------------- index and order


@query("SELECT CAST((n - 1) // 8 AS BIGINT) AS block, max(o_orderkey) AS last_key, count(*) AS rows FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def block_index_every_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_index(orders(spark, sf_dir), 8)


@query("SELECT count(*) AS out_of_order FROM (SELECT l_orderkey AS k, lag(l_orderkey) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS p FROM lineitem) WHERE p >= k")
def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a strict writer rejects: rows that repeat a key."""
    found = repeats(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))).where("key is not null")
    return found.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("out_of_order"))
