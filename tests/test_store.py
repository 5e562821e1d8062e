import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from stratakv.errors import InvalidFormatVersion, OrderError
from stratakv.functions import keys
from stratakv.model import UNBOUNDED, excluded, included
from stratakv.operators import cursor, scans
from stratakv.plans import ranged
from stratakv.sources.codecs import Codec
from stratakv.sources.store import Reader, Writer, block_index, check_ascending


def key(n):
    return n.to_bytes(4, "big")


def numbers(spark, some):
    df = spark.createDataFrame([(n,) for n in some], "n long")
    return df.select(keys.be_u32(F.col("n")).alias("key"), keys.be_u32(F.col("n")).alias("val"))


def read(df):
    return [int.from_bytes(r.key, "big") for r in df.collect()]


SPARSE = list(range(10, 24_000, 3))


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    from dataclasses import replace

    options = replace(Writer.builder().compression_type("snappy").index_levels(2).partitions(3), block_rows=500)
    return options.build(str(tmp_path_factory.mktemp("store") / "sparse")).write(numbers(spark, SPARSE), strict=True)


def test_round_trip_and_metadata(spark, tmp_path):
    for codec in Codec:
        w = Writer.builder().compression_type(codec).compression_level(3).block_size(10).index_key_interval(16).build(str(tmp_path / codec.name))
        r = w.insert(numbers(spark, range(0, 1000))).insert(numbers(spark, range(1000, 2000))).into_inner()
        assert read(r.into_cursor()) == list(range(2000))
        assert (len(r), r.is_empty(), r.compression_type(), r.file_version(), r.into_inner()) == (2000, False, codec, 2, str(tmp_path / codec.name))
    assert read(Reader.open(spark, str(tmp_path / "ZSTD")).into_cursor()) == list(range(2000))


def test_empty(spark, tmp_path):
    r = Writer(str(tmp_path / "none")).insert(numbers(spark, [1]).where("false")).into_inner()
    assert len(r) == 0 and r.is_empty()
    moves = [r.into_cursor(), r.move_on_first(), r.move_on_last(), r.move_on_next(), r.move_on_prev(), r.move_on_next(b"a"), r.move_on_key_equal_to(b""), r.move_on_key_greater_than_or_equal_to(b""), r.move_on_key_lower_than_or_equal_to(b"z"), r.into_range_iter(), r.into_prefix_iter(b"")]
    assert all(m.count() == 0 for m in moves)


def test_strict(spark, tmp_path):
    with pytest.raises(OrderError):
        Writer(str(tmp_path / "twice")).insert(numbers(spark, [1, 2, 2])).finish()
    with pytest.raises(OrderError):
        Writer(str(tmp_path / "disorder")).insert(numbers(spark, [2, 1]).withColumn("seq", -F.conv(F.hex("key"), 16, 10).cast("long"))).finish()
    nothing = Writer(str(tmp_path / "nothing")).into_inner()
    assert nothing.is_empty() and nothing.into_cursor().collect() == []
    rows = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"c")], "seq long, key binary")
    check_ascending(rows)
    for bad in ([(1, b"a"), (2, b"a")], [(1, b"b"), (2, b"a")]):
        with pytest.raises(OrderError):
            check_ascending(spark.createDataFrame(bad, "seq long, key binary"))


def test_unknown_version(spark, tmp_path):
    path = str(tmp_path / "new")
    Writer(path).write(numbers(spark, [1]))
    spark.createDataFrame([(9, "none", 1, 0, None, None)], "format_version int, compression string, entries long, index_levels int, block_size long, index_key_interval long").write.mode("overwrite").parquet(f"{path}/_meta")
    with pytest.raises(InvalidFormatVersion):
        Reader.open(spark, path)


def one(df):
    return (read(df) or [None])[0]


def test_moves(sparse):
    assert one(sparse.move_on_first()) == SPARSE[0] and one(sparse.move_on_last()) == SPARSE[-1]
    assert one(sparse.move_on_next()) == SPARSE[0] and one(sparse.move_on_prev()) == SPARSE[-1]
    for n in (0, 9, 10, 11, 12, 13, 1509, 1510, 12_000, SPARSE[-1], SPARSE[-1] + 1, 24_019):
        i, j = bisect.bisect_left(SPARSE, n), bisect.bisect_right(SPARSE, n)
        at = lambda k: SPARSE[k] if 0 <= k < len(SPARSE) else None
        assert one(sparse.move_on_key_greater_than_or_equal_to(key(n))) == at(i)
        assert one(sparse.move_on_key_lower_than_or_equal_to(key(n))) == at(j - 1)
        assert one(sparse.move_on_key_equal_to(key(n))) == (n if i < j else None)
        assert one(sparse.move_on_next(key(n))) == at(j)
        assert one(sparse.move_on_prev(key(n))) == at(i - 1)


def test_batch_moves(spark, sparse):
    asked = list(range(0, 24_020, 7)) + [10, 10, 13]
    probes = spark.createDataFrame([(n,) for n in asked], "n long").select(keys.be_u32(F.col("n")).alias("probe"))
    found = lambda df: sorted((int.from_bytes(r.probe, "big"), r.key and int.from_bytes(r.key, "big"), r.val and int.from_bytes(r.val, "big")) for r in df.collect())
    low = [(n, SPARSE[k - 1], SPARSE[k - 1]) if (k := bisect.bisect_right(SPARSE, n)) else (n, None, None) for n in asked]
    high = [(n, SPARSE[k], SPARSE[k]) if (k := bisect.bisect_left(SPARSE, n)) < len(SPARSE) else (n, None, None) for n in asked]
    same = [(n, n, n) if n in set(SPARSE) else (n, None, None) for n in asked]
    order = lambda rows: sorted(rows)
    assert found(cursor.at_or_below_many(probes, sparse.entries)) == order(low)
    assert found(cursor.at_or_above_many(probes, sparse.entries)) == order(high)
    assert found(cursor.equal_to_many(probes, sparse.entries)) == order(same)
    assert found(sparse.seek_lower_than_or_equal_to(probes)) == order(low)
    assert found(sparse.seek_greater_than_or_equal_to(probes)) == order(high)
    assert found(sparse.seek_equal_to(probes)) == order(same)
    few = probes.where(F.conv(F.hex("probe"), 16, 10).cast("long") % 50 == 0)
    some = [n % 50 == 0 for n in asked]
    assert found(sparse.seek_lower_than_or_equal_to(few)) == order(x for x, s in zip(low, some, strict=True) if s)
    assert found(sparse.seek_greater_than_or_equal_to(few)) == order(x for x, s in zip(high, some, strict=True) if s)
    assert found(sparse.seek_equal_to(few)) == order(x for x, s in zip(same, some, strict=True) if s)
    assert sparse.seek_greater_than_or_equal_to(probes.where("false")).count() == 0
    none = sparse.entries.where("false")
    assert {r.key for r in cursor.at_or_above_many(probes, none).collect()} == {None}


def test_ranges(sparse):
    rng = random.Random(7)
    bounds = {"i": included, "e": excluded, "u": lambda k: UNBOUNDED}
    for shape in [a + b for a in "ieu" for b in "ieu"] * 2:
        lo, hi = rng.randrange(24_020), rng.randrange(24_020)
        expect = [n for n in SPARSE if {"i": n >= lo, "e": n > lo, "u": True}[shape[0]] and {"i": n <= hi, "e": n < hi, "u": True}[shape[1]]]
        a, b = bounds[shape[0]](key(lo)), bounds[shape[1]](key(hi))
        assert read(sparse.into_range_iter(a, b)) == expect
        assert read(sparse.into_rev_range_iter(a, b)) == expect[::-1]


def test_prefixes(sparse):
    rng = random.Random(8)
    for _ in range(12):
        prefix = key(rng.randrange(24_020))[: rng.randrange(5)]
        expect = [n for n in SPARSE if key(n).startswith(prefix)]
        assert read(sparse.into_prefix_iter(prefix)) == expect
        assert read(sparse.into_rev_prefix_iter(prefix)) == expect[::-1]


def test_prefix_of_all_ones(spark):
    tails = [("000000FE", b"world"), ("000000FF", b"hello"), ("000000FF", b"world"), ("00000100", b"world"), ("000001", b"hello"), ("FFFFFF", b""), ("FFFF", b"x"), ("", b"")]
    rows = [(bytes.fromhex(p) + t, t) for p, t in tails]
    df = spark.createDataFrame(rows, "key binary, val binary")
    for prefix in (bytes.fromhex("000000FF"), b"\xff", b"\xff\xff", b"", b"\x00"):
        expect = sorted(k for k, _ in rows if k.startswith(prefix))
        assert [bytes(r.key) for r in scans.prefix_scan(df, prefix).collect()] == expect
        assert [bytes(r.key) for r in scans.rev_prefix_scan(df, prefix).collect()] == expect[::-1]


def test_filters_reach_the_scan(sparse, capsys):
    sparse.into_prefix_iter(key(300)[:3]).explain()
    out = capsys.readouterr().out
    assert "GreaterThanOrEqual(key" in out and "LessThan(key" in out
    sparse.move_on_key_equal_to(key(13)).explain()
    assert "EqualTo(key" in capsys.readouterr().out


def test_moves_read_one_block(sparse):
    """A seek is bounded on both sides."""
    rows = sparse.index.orderBy("last_key").collect()
    assert len(rows) >= 16 and sum(r.rows for r in rows) == len(SPARSE)
    assert all(a.last_key < b.first_key for a, b in zip(rows, rows[1:], strict=False))


def test_batch_of_seeks_reads_the_blocks_hit(spark, sparse, capsys):
    probes = spark.createDataFrame([(n,) for n in (11, 1200, 12_001, 23_990, 12_002)], "n long").select(keys.be_u32(F.col("n")).alias("probe"))
    hit = cursor.hits(probes, sparse.index, True)
    blocks = {(r.first_key, r.last_key) for r in hit.collect()}
    assert hit.count() == 5 and len(blocks) == 3
    rows = cursor.named(probes, sparse.index, True)[1]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, hit.collect()))
    some = cursor.blocks_read(sparse.placed, rows)
    assert some.count() == sum(r["rows"] for r in sparse.index.collect() if (r.first_key, r.last_key) in blocks) <= 2000
    some.explain()
    assert "PushedFilters: [Or(" in capsys.readouterr().out
    assert cursor.blocks_read(sparse.placed, []).count() == 0


def test_seeks_of_many_probes_broadcast_no_entries(spark, tmp_path, capsys):
    """Entries that compress well look small to Spark: 300,000 of them, in less than its 10 MB of a broadcast."""
    df = spark.range(0, 600_000, 2)
    r = Writer.builder().compression_type("zstd").build(str(tmp_path / "even")).insert(df.select(keys.be_u64(F.col("id")).alias("key"), keys.be_u64(F.col("id")).alias("val"))).into_inner()
    for n, join in ((150_000, "SortMergeJoin"), (20_000, "BroadcastHashJoin")):
        probes = spark.range(0, 4 * n).select(keys.be_u64(F.floor(F.col("id") / 4) * 3).alias("probe"))
        found = r.seek_equal_to(probes)
        found.explain()
        plan = capsys.readouterr().out
        assert re.findall(r"(\w+) \[probe#\d+\], \[key#\d+\], Inner(.*)", plan)[0] == (join, ", BuildLeft, false" if join[0] == "B" else "")
        assert not re.search(r"BroadcastHashJoin \[probe#\d+\], \[__p#", plan)
        rows = found.groupBy(F.col("key").isNull().alias("none"), (F.col("key") == F.col("probe")).alias("same"), (F.col("val") == F.col("probe")).alias("val")).count().collect()
        assert sorted(tuple(x) for x in rows) == sorted([(False, True, True, 2 * n), (True, None, None, 2 * n)], key=str)


def test_seeks_by_blocks_broadcast_no_entries(spark, sparse, monkeypatch, capsys):
    monkeypatch.setattr(cursor, "NAMED_PROBES", 8)
    asked = list(range(0, 24_020, 400))
    probes = spark.createDataFrame([(n,) for n in asked], "n long").select(keys.be_u32(F.col("n")).alias("probe"))
    for most in (0, 8 << 20):
        monkeypatch.setattr(cursor, "MOST_BROADCAST", most, raising=False)
        for up in (True, False):
            found = (sparse.seek_greater_than_or_equal_to if up else sparse.seek_lower_than_or_equal_to)(probes)
            found.explain()
            joins = re.findall(r"(\w+) \[file#\d+, (?:block|row)#\d+L\], \[file#\d+, (block|row)#\d+L\], Inner(?:, (Build\w+))?", capsys.readouterr().out)
            if most:
                assert sorted(set(joins)) == [("BroadcastHashJoin", "block", "BuildLeft"), ("BroadcastHashJoin", "block", "BuildRight"), ("BroadcastHashJoin", "row", "BuildLeft")]
            else:
                assert sorted(set(joins)) == [("SortMergeJoin", "block", ""), ("SortMergeJoin", "row", "")]
            spots = [bisect.bisect_left(SPARSE, n) if up else bisect.bisect_right(SPARSE, n) - 1 for n in asked]
            expect = {n: SPARSE[k] if 0 <= k < len(SPARSE) else None for n, k in zip(asked, spots, strict=True)}
            assert {int.from_bytes(x.probe, "big"): x.key and int.from_bytes(x.key, "big") for x in found.collect()} == expect


def test_ranged_windows(spark):
    some = random.Random(3).sample(range(10_000), 700)
    df = spark.createDataFrame([(n,) for n in some], "key long")
    order = sorted(some)
    for buckets in (1, 5, 64):
        walked = {r.key: (r.prev_key, r.next_key) for r in ranged.with_neighbours(df, "key", buckets).collect()}
        assert walked == {n: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, n in enumerate(order)}
        assert {r.key: r.place for r in ranged.with_index(df, "key", "place", buckets).collect()} == {n: i for i, n in enumerate(order)}
        assert {r.key: r.place for r in ranged.with_index(df, "key", "place", buckets, True).collect()} == {n: i for i, n in enumerate(order[::-1])}
    assert ranged.with_neighbours(df.where("false")).count() == 0


def test_ranged_windows_of_two_levels(spark, monkeypatch):
    """More ranges than one level holds: keys are cut a second time, by a sample of their own."""
    monkeypatch.setattr(ranged, "WIDE", 8)
    monkeypatch.setattr(ranged, "SAMPLE", 200)
    some = random.Random(4).sample(range(100_000), 3000)
    for encoded in (False, True):
        df = spark.createDataFrame([(n,) for n in some], "key long")
        if encoded:  # beyond a shared prefix
            df = df.select(F.concat(F.lit(b"p" * 40), keys.be_u64(F.col("key"))).alias("key"))
        order = sorted(r.key for r in df.collect())
        by = ranged.ranges(df, "key", 50)
        assert by.count == 8 * 7 and by.inner.count() == 8
        sizes = {r["__bucket"]: r["count"] for r in by.put(df, "key").groupBy("__bucket").count().collect()}
        assert len(sizes) > 50 and max(sizes.values()) < 250 and sum(sizes.values()) == 3000
        walked = {r.key: (r.prev_key, r.next_key) for r in ranged.with_neighbours(df, "key", 50).collect()}
        assert walked == {n: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, n in enumerate(order)}
        for down in (False, True):
            places = {r.key: r.place for r in ranged.with_index(df, "key", "place", 50, down).collect()}
            assert places == {n: i for i, n in enumerate(order[::-1] if down else order)}
        table = df.where(F.pmod(F.xxhash64("key"), F.lit(7)) == 0).withColumn("val", F.lit(1))
        has = sorted(r.key for r in table.collect())
        for below in (False, True):
            found = {r.probe: r.key for r in ranged.as_of(df.withColumnRenamed("key", "probe"), table, below, 50).collect()}
            spots = {n: bisect.bisect_right(has, n) - 1 if below else bisect.bisect_left(has, n) for n in order}
            assert found == {n: has[k] if 0 <= k < len(has) else None for n, k in spots.items()}


def test_no_window_over_all_rows(spark, capsys):
    df = spark.range(1000).select(F.col("id").alias("key"))
    ranged.with_index(df, "key", "i", 8).explain()
    plan = capsys.readouterr().out
    assert plan.count("SinglePartition") == 1  # of the buckets' counts


def test_block_index(spark):
    df = spark.range(100).select(F.col("id").alias("key"), F.lit(1).alias("val"))
    rows = sorted((r.block, r.last_key, r["rows"]) for r in block_index(df, 8).collect())
    assert rows == [(b, min(8 * b + 7, 99), min(8, 100 - 8 * b)) for b in range(13)]


def test_cursor(spark, tmp_path):
    rows = spark.createDataFrame([(b"first-counter", b"119"), (b"second-counter", b"384"), (b"", b"empty")], "key binary, val binary")
    c = Writer(str(tmp_path / "counters")).insert(rows).into_inner().cursor()
    assert c.current() is None
    assert c.move_on_next() == (b"", b"empty") and c.move_on_next() == (b"first-counter", b"119") and c.move_on_next() == (b"second-counter", b"384")
    assert c.move_on_next() is None and c.current() == (b"second-counter", b"384")
    assert c.move_on_prev() == (b"first-counter", b"119")
    c.reset()
    assert c.move_on_prev() == (b"second-counter", b"384")
    assert c.move_on_key_greater_than_or_equal_to(b"first") == (b"first-counter", b"119")
    assert c.move_on_key_equal_to(b"second-counter") == (b"second-counter", b"384")
    assert c.move_on_key_equal_to(b"third") is None
    assert c.move_on_key_lower_than_or_equal_to(b"abracadabra") == (b"", b"empty")
    assert c.move_on_first() == (b"", b"empty") and c.move_on_last()[0] == b"second-counter" and len(c.into_reader()) == 3
