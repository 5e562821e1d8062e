import random

import pytest
from pyspark.sql import functions as F

from stratakv.errors import InvalidCompressionType
from stratakv.functions import keys
from stratakv.model import entries
from stratakv.sources.codecs import Codec


def test_after_prefix():
    cases = {bytes([0, 255]): bytes([1]), bytes([255]): None, bytes([254]): bytes([255]), bytes([0, 255, 255]): bytes([1]), bytes([255] * 3): None, b"": None, b"ab": b"ac"}
    for prefix, expect in cases.items():
        assert keys.after_prefix(prefix) == expect


def test_numbers_sort_as_bytes(spark):
    rng = random.Random(1)
    numbers = [0, 1, -1, 255, 256, -(1 << 31), (1 << 31) - 1, *[rng.randrange(-(1 << 31), 1 << 31) for _ in range(200)]]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for encode, decode in ((keys.be_i32, keys.from_be_i32), (keys.be_i64, keys.from_be_i64)):
        rows = df.select("n", encode(F.col("n")).alias("k")).orderBy("k").select("n", decode(F.col("k")).alias("back")).collect()
        assert [r.n for r in rows] == sorted(numbers) == [r.back for r in rows]
    one = df.where("n >= 0").select("n", keys.be_u32(F.col("n")).alias("b"), keys.be_u64(F.col("n")).alias("w"), keys.le_u32(F.col("n")).alias("l"))
    for r in one.withColumn("back", keys.from_le_u32(F.col("l"))).withColumn("again", keys.from_be(F.col("b"))).collect():
        assert r.b == r.n.to_bytes(4, "big") and r.w == r.n.to_bytes(8, "big") and r.l == r.n.to_bytes(4, "little")
        assert r.back == r.again == r.n


def test_byte_order(spark):
    some = [b"", b"\x00", b"a", b"ab", b"\x7f", b"\x80", b"\xff", b"\xff\x00", b"a\x00"]
    got = [bytes(r.key) for r in spark.createDataFrame([(k,) for k in some[::-1]], "key binary").orderBy("key").collect()]
    assert got == sorted(some)


def test_nulls_are_rejected(spark):
    df = spark.createDataFrame([(b"a", None)], "key binary, val binary")
    with pytest.raises(Exception, match="null val"):
        entries(df).collect()


def test_codecs():
    assert [Codec.of_number(c.number) for c in Codec] == list(Codec)
    assert [Codec.parse(c.label) for c in Codec] == list(Codec)
    assert Codec.parse("uncompressed") is Codec.NONE
    with pytest.raises(InvalidCompressionType):
        Codec.parse("brotli")
    with pytest.raises(InvalidCompressionType):
        Codec.of_number(9)
