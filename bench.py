"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first pass over a query warms the JVM; the time reported is the better of two more.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.functions.keys import be_u32, be_u64
from stratakv.functions.merge import SUM
from stratakv.model import included
from stratakv.operators import cursor
from stratakv.operators.merger import Merger
from stratakv.operators.sorter import Sorter
from stratakv.plans.scratch import scratch
from stratakv.plans.ship import ship
from stratakv.queries import QUERIES
from stratakv.sources.store import Reader, Writer

HEADLINES = ["sorter_sum_wrapping", "sorter_concat_stable", "sorter_merge_udf", "merger_kway_sum", "merger_source_order", "cursor_walk", "seek_le", "seek_ge", "range_ii", "prefix_ff"]
ROWS, STEP = 1_000_000, 1567


def timed(run) -> float:
    run()
    best = float("inf")
    for _ in range(2):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 4)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def million(spark: SparkSession) -> DataFrame:
    """8-byte keys, and 120-byte values of 30 numbers."""
    ids = spark.range(ROWS)
    return ids.select(be_u64(F.col("id")).alias("key"), F.concat(*[be_u32(F.lit(k)) for k in range(30)]).alias("val"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    times = {name: timed(lambda name=name: drain(QUERIES[name](spark, sf_dir))) for name in HEADLINES}

    readers: list[Reader] = []
    times["write_1m_snappy"] = timed(lambda: readers.append(Writer.builder().compression_type("snappy").build(scratch(spark, "bench")).write(million(spark))))
    reader = readers[-1]
    probes = spark.range(0, ROWS, STEP).select(be_u64(F.col("id")).alias("probe"))
    times["scan_1m"] = timed(lambda: drain(reader.into_cursor()))
    times["seek_ge_639_of_1m"] = timed(lambda: drain(cursor.at_or_above_many(probes, reader.entries)))
    times["seek_ge_639_by_index"] = timed(lambda: drain(reader.seek_greater_than_or_equal_to(probes)))
    times["seek_eq_1m"] = timed(lambda: drain(reader.move_on_key_equal_to((777_777).to_bytes(8, "big"))))
    times["seek_ge_1m"] = timed(lambda: drain(reader.move_on_key_greater_than_or_equal_to((777_777).to_bytes(8, "big"))))
    times["first_last_1m"] = timed(lambda: (drain(reader.move_on_first()), drain(reader.move_on_last())))
    times["range_1000_of_1m"] = timed(lambda: drain(reader.into_range_iter(included((500_000).to_bytes(8, "big")), included((500_999).to_bytes(8, "big")))))
    times["prefix_256_of_1m"] = timed(lambda: drain(reader.into_prefix_iter((0x0800).to_bytes(7, "big"))))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("val"), "l_returnflag")
    sources = [Sorter.new(SUM).insert(items.where(F.col("l_returnflag") == f).drop("l_returnflag")).merged() for f in "ANR"]

    def compact() -> None:
        merger = Merger.builder(SUM)
        merger.extend(sources)
        merger.build().write_into_stream_writer(Writer(scratch(spark, "bench")))

    times["merge_3_and_write"] = timed(compact)
    # a fixed job of built-in functions only: how fast the machine is, and no headline
    fixed = timed(lambda: drain(spark.range(20_000_000).select(F.xxhash64("id").alias("h")).groupBy(F.pmod("h", F.lit(1000))).agg(F.max("h"))))
    total = round(sum(times.values()), 4)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "calibration_sec": fixed}))
    spark.stop()


if __name__ == "__main__":
    main()
