import random

import pytest
from pyspark.sql import functions as F

from stratakv.errors import MergeError
from stratakv.functions import keys, merge
from stratakv.operators.merger import Merger
import stratakv.operators.sorter as sorter_module
from stratakv.operators.sorter import UNSTABLE, Sorter

SHAPE = "key string, val string, seq long"


def numbered(rows):
    return [(k, v, i) for i, (k, v) in enumerate(rows)]


def pairs(df):
    return [(r.key, r.val) for r in df.collect()]


def test_concat(spark):
    rows = numbered([("hello", "kiki"), ("abstract", "lol"), ("allo", "lol"), ("abstract", "lol")])
    got = pairs(Sorter.new(merge.CONCAT).insert(spark.createDataFrame(rows, SHAPE)).into_stream_merger_iter())
    assert got == [("abstract", "lollol"), ("allo", "lol"), ("hello", "kiki")]


def test_one_hot_key(spark):
    rows = numbered([("hello", "kiki")] * 200)
    assert pairs(Sorter.new(merge.CONCAT).insert(spark.createDataFrame(rows, SHAPE)).into_stream_merger_iter()) == [("hello", "kiki" * 200)]


def test_stable_order_of_bytes(spark):
    rng = random.Random(42)
    rows = [(rng.choice("abcdef").encode(), bytes([n]), n) for n in range(256)]
    df = spark.createDataFrame(rows, "key binary, val binary, seq long").repartition(7)
    for r in Sorter.new(merge.CONCAT_BYTES).insert(df).into_stream_merger_iter().collect():
        assert list(r.val) == sorted(v[0] for k, v, _ in rows if k == bytes(r.key))


def counters(spark, rows):
    return spark.createDataFrame(rows, "key string, n long").select("key", keys.le_u32(F.col("n")).alias("b")).select("key", keys.from_le_u32(F.col("b")).alias("val"))


def test_wrapping_sum(spark):
    rows = [("first-counter", 32), ("first-counter", 23), ("first-counter", 64), ("second-counter", 320), ("second-counter", 64)]
    assert pairs(Sorter.new(merge.SUM_U32).insert(counters(spark, rows)).into_stream_merger_iter()) == [("first-counter", 119), ("second-counter", 384)]
    many = [("k", (1 << 32) - 1)] * 5
    assert pairs(Sorter.new(merge.SUM_U32).insert(counters(spark, many)).into_stream_merger_iter()) == [("k", 5 * ((1 << 32) - 1) % (1 << 32))]


def test_merger(spark):
    a = counters(spark, [("first-counter", 32), ("second-counter", 64)])
    b = counters(spark, [("first-counter", 23), ("second-counter", 320)])
    c = counters(spark, [("first-counter", 64)])
    assert pairs(Merger.builder(merge.SUM_U32).add(a).add(b).add(c).build().into_stream_merger_iter()) == [("first-counter", 119), ("second-counter", 384)]
    behind = Merger.builder(merge.SUM_U32).add(a, after_key="first-counter").add(b).build()
    assert pairs(behind.into_stream_merger_iter()) == [("first-counter", 23), ("second-counter", 384)]
    assert pairs(Merger.builder(merge.SUM_U32).add(a.where("false")).build().into_stream_merger_iter()) == []


def test_sources_order_values(spark):
    s = [spark.createDataFrame([("k", x)], "key string, val string") for x in "zya"]
    for some in ([0, 1, 2], [2, 0, 1]):
        merger = Merger.builder(merge.CONCAT)
        merger.extend(s[k] for k in some)
        assert pairs(merger.build().into_stream_merger_iter()) == [("k", "".join("zya"[k] for k in some))]


def test_catalogue(spark):
    rows = numbered([("a", "3"), ("a", "1"), ("b", "9"), ("a", "2"), ("a", "1")])
    df = spark.createDataFrame(rows, SHAPE)
    expect = {merge.FIRST: "3", merge.LAST: "1", merge.MIN: "1", merge.MAX: "3", merge.CONCAT: "3121", merge.SET_UNION: "1,2,3"}
    for m, value in expect.items():
        assert pairs(Sorter.new(m).insert(df).into_stream_merger_iter()) == [("a", value), ("b", "9")]
    ints = df.select("key", F.col("val").cast("long").alias("val"), "seq")
    for m, value in {merge.SUM: 7, merge.COUNT: 7, merge.BIT_OR: 3}.items():
        assert pairs(Sorter.new(m).insert(ints).into_stream_merger_iter()) == [("a", value), ("b", 9)]
    chosen = merge.either(merge.FIRST, merge.LAST, False)
    assert chosen is merge.LAST


def test_udf_and_its_failure(spark):
    df = spark.createDataFrame([(b"a", b"x", 0), (b"a", b"y", 1), (b"b", b"z", 2)], "key binary, val binary, seq long")
    joined = merge.udf(lambda key, values: key + b":" + b"+".join(values))
    assert [bytes(r.val) for r in Sorter.new(joined).insert(df).into_stream_merger_iter().collect()] == [b"a:x+y", b"b:z"]
    bad = merge.udf(lambda key, values: 1 // 0, "bad")
    with pytest.raises(Exception, match="merge function bad failed"):
        Sorter.new(bad).insert(df).into_stream_merger_iter().collect()


def test_python_merges_fold_runs_first(spark):
    """No call of the function sees more values than a run has, and order holds over runs."""
    n = 3 << sorter_module.RUN_BITS
    df = spark.range(n).select(F.lit(b"k").alias("key"), F.encode(F.concat(F.col("id").cast("string"), F.lit(",")), "UTF-8").alias("val"), F.col("id").alias("seq"))
    most = 1 << sorter_module.RUN_BITS

    def join(key, values):
        assert len(values) <= most
        return b"".join(values)

    (row,) = Sorter.new(merge.udf(join)).insert(df).into_stream_merger_iter().collect()
    assert bytes(row.val) == b"".join(b"%d," % i for i in range(n))
    (row,) = Sorter.builder(merge.udf(lambda k, v: min(v))).sort_algorithm(UNSTABLE).build().insert(df.drop("seq")).into_stream_merger_iter().collect()
    assert bytes(row.val) == b"0,"


def test_ordered_merges_move_once(spark, capsys):
    df = spark.createDataFrame(numbered([("b", "1"), ("a", "2"), ("a", "3")]), SHAPE)
    df = df.union(df.where("false"))
    found = Sorter.new(merge.CONCAT).insert(df).into_stream_merger_iter()
    assert pairs(found) == [("a", "23"), ("b", "1")]
    found.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_contract():
    samples = [[b"a", b"b", b"c"], [b"x"], []]
    merge.check_contract(lambda k, v: b"".join(v), samples)
    with pytest.raises(MergeError):
        merge.check_contract(lambda k, v: b"(" + b"".join(v) + b")", samples)
    with pytest.raises(MergeError):
        merge.check_contract(lambda k, v: v[0] if len(v) < 2 else b"".join(reversed(v)) + b"!", samples)


def test_runs_are_not_merged(spark):
    sorter = Sorter.new(merge.CONCAT)
    for part in ([("b", "1"), ("a", "2")], [("a", "3"), ("a", "4")]):
        sorter.insert(spark.createDataFrame(numbered(part), SHAPE))
    assert [pairs(r) for r in sorter.into_reader_cursors()] == [[("a", "2"), ("b", "1")], [("a", "34")]]
    assert pairs(sorter.into_stream_merger_iter()) == [("a", "234"), ("b", "1")]
    assert "chunks=2" in repr(sorter)
    assert sorter.estimated_dumped_memory_usage().first()["bytes"] == 4 * (1 + 1 + 16)


def test_options():
    b = Sorter.builder(merge.SUM).dump_threshold(1).allow_realloc(False).max_nb_chunks(0).chunk_compression_type("lz4").chunk_compression_level(3).index_key_interval(4).block_size(1).index_levels(2).sort_algorithm(UNSTABLE).sort_in_parallel(True).chunk_creator(None)
    assert (b.dump_threshold_, b.max_nb_chunks_, b.block_size_, b.algorithm) == (10 << 20, 1, 1024, UNSTABLE)
    with pytest.raises(ValueError):
        b.sort_algorithm("bogo")
    with pytest.raises(ValueError):
        b.index_key_interval(0)


def test_missing_order_and_empty(spark):
    with pytest.raises(MergeError):
        Sorter.new(merge.CONCAT).insert(spark.createDataFrame([("a", "b")], "key string, val string"))
    bare = Sorter.new(merge.SUM)
    assert [bare.into_stream_merger_iter().count(), bare.per_run().count(), len(bare.into_reader_cursors()), bare.estimated_dumped_memory_usage().first()["bytes"]] == [0, 0, 0, 0]
    empty = spark.createDataFrame([], SHAPE)
    assert pairs(Sorter.new(merge.CONCAT).insert(empty).into_stream_merger_iter()) == []
    assert Sorter.new(merge.CONCAT).insert(empty).estimated_dumped_memory_usage().first()["bytes"] == 0


def test_merging_in_parts_is_merging_at_once(spark):
    """Associativity through stored runs: any split into chunks gives the same."""
    rng = random.Random(9)
    rows = numbered([(rng.choice("abc"), str(n)) for n in range(60)])
    whole = pairs(Sorter.new(merge.CONCAT).insert(spark.createDataFrame(rows, SHAPE)).into_stream_merger_iter())
    for cut in (1, 30, 59):
        runs = [Sorter.new(merge.CONCAT).insert(spark.createDataFrame(p, SHAPE)).merged() for p in (rows[:cut], rows[cut:])]
        merger = Merger.builder(merge.CONCAT)
        merger.extend(runs)
        assert pairs(merger.build().into_stream_merger_iter()) == whole


def test_sum_combines_before_the_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("val"))
    Sorter.new(merge.SUM).insert(df).merged().explain()
    assert "partial_sum" in capsys.readouterr().out
