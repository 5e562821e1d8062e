from pyspark.sql import functions as F

from stratakv.functions.merge import CONCAT, SUM
from stratakv.sources.store import Reader
from stratakv.streaming.ingest import StreamSorter


def test_stream_of_batches(spark, tmp_path):
    source = tmp_path / "in"
    sorter = StreamSorter(spark, SUM, str(tmp_path / "runs"), max_runs=3)
    for n in range(5):
        spark.range(10 * n, 10 * n + 10).select((F.col("id") % 7).alias("key"), F.col("id").alias("val")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("key long, val long").parquet(str(source))
        sorter.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    expect = {}
    for i in range(50):
        expect[i % 7] = expect.get(i % 7, 0) + i
    rows = [(r.key, r.val) for r in sorter.read().collect()]
    assert rows == sorted(expect.items())
    assert len(sorter.runs()) < 4 and sorter.runs()[0][0] == 0 and sorter.runs()[-1][1] == 4


def test_a_batch_counts_once(spark, tmp_path):
    sorter = StreamSorter(spark, CONCAT, str(tmp_path / "runs"), max_runs=100)
    assert sorter.read().count() == 0
    batches = [spark.createDataFrame([("k", x, 0)], "key string, val string, seq long") for x in "abc"]
    for n in (0, 1, 1, 0, 2):
        sorter.write_batch(batches[n], n)
    assert [tuple(r) for r in sorter.read().collect()] == [("k", "abc")]
    sorter.compact()
    sorter.write_batch(batches[1], 1)
    assert sorter.runs() == [(0, 2)] and [tuple(r) for r in sorter.read().collect()] == [("k", "abc")]
    assert len(Reader.open(spark, str(tmp_path / "runs" / "run-000000000-000000002"))) == 1
