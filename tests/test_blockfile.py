import random

import pytest
from pyspark.sql import functions as F

from stratakv.errors import InvalidFormatVersion, KvError, OrderError
from stratakv.functions import keys
from stratakv.functions.merge import CONCAT_BYTES
from stratakv.operators.merger import Merger
from stratakv.sources import blockfile as bf
from stratakv.sources.codecs import Codec


def made(entries, **options):
    f = bf.BlockFile(**options)
    for k, v in entries:
        f.add(k, v)
    return f.finish()


def numbers(n, step=1):
    return [((x).to_bytes(4, "big"), (x * 7).to_bytes(4, "big") * 9) for x in range(0, n, step)]


@pytest.mark.parametrize("codec", list(Codec))
@pytest.mark.parametrize("levels", [0, 2])
def test_round_trip(codec, levels):
    data = numbers(3000, 3)
    raw = made(data, codec=codec, block_size=1024, levels=levels)
    f = bf.footer(raw)
    assert (f.version, f.codec, f.entries, f.levels) == (2, codec, 1000, levels)
    assert list(bf.entries_of(raw)) == data
    rng = random.Random(2)
    for _ in range(60):
        lo, hi = sorted((rng.randrange(3100).to_bytes(4, "big"), rng.randrange(3100).to_bytes(4, "big")))
        assert list(bf.entries_of(raw, lo, hi)) == [e for e in data if lo <= e[0] <= hi]


def test_layout_of_a_small_file():
    """Byte by byte, from the format's definition."""
    raw = made([(b"a", b"xy")])
    payload = b"\x01\x02axy" + bytes(8) + b"\x00\x00\x00\x01"
    index = b"\x01\x08a" + bytes(8) + bytes(8) + b"\x00\x00\x00\x01"
    blocks = len(payload).to_bytes(8, "big") + payload + len(index).to_bytes(8, "big") + index
    at = 8 + len(payload)
    assert raw == blocks + at.to_bytes(8, "little") + b"\x00" + (1).to_bytes(8, "little") + b"\x00" + (0x6723D4C4).to_bytes(4, "little")
    old = raw[: -bf.FOOTER_V2.size] + bf.FOOTER_V1.pack(at, 0, 1, bf.MAGIC_V1)
    assert bf.footer(old).version == 1 and list(bf.entries_of(old)) == [(b"a", b"xy")]


def test_empty_and_odd():
    assert list(bf.entries_of(made([]))) == []
    odd = [(b"", b""), (b"\x00", b"x" * 70_000), (b"\xff" * 300, b"")]
    assert list(bf.entries_of(made(odd, block_size=1024, levels=1))) == odd
    for n in (0, 1, 127, 128, 16_383, 16_384, 2**32 - 1):
        assert bf.varint(bf.coded(n) + b"z", 0) == (n, len(bf.coded(n)))
    with pytest.raises(OrderError):
        made([(b"b", b""), (b"b", b"")])
    with pytest.raises(InvalidFormatVersion):
        bf.footer(b"short")
    with pytest.raises(InvalidFormatVersion):
        bf.footer(bytes(40))
    raw = bytearray(bf.compress(Codec.SNAPPY, 0, b"some text " * 20))
    raw[-1] ^= 1
    with pytest.raises((KvError, OSError)):
        bf.decompress(Codec.SNAPPY, bytes(raw))


def test_checksum():
    assert bf.masked_crc32c(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 255, 4095, 4096, 4097, 9000):
        data = rng.randbytes(n)
        c = 0xFFFFFFFF
        for b in data:
            for k in range(8):
                c = c >> 1 ^ (0x82F63B78 if (c ^ b >> k) & 1 else 0)
        assert bf.crc32c(data) == c ^ 0xFFFFFFFF


def test_keys_that_start_alike(spark, tmp_path):
    df = spark.range(4000).select(F.encode(F.format_string("https://www.example.com/page/%08d", "id"), "UTF-8").alias("key"), keys.be_u32(F.col("id")).alias("val"))
    done = bf.write_block_files(df, f"file://{tmp_path}/a", partitions=4)
    assert len({r.file for r in done.collect()}) == done.count() == 4
    back = bf.read_block_files(spark, f"{tmp_path}/a")
    assert back.count() == 4000 and back.select("key", "val").exceptAll(df).count() == 0


def test_direct(spark, tmp_path):
    """Workers that open files themselves read what a range needs."""
    df = spark.range(20_000).select(keys.be_u32(F.col("id")).alias("key"), keys.be_u32(F.col("id") * 3).alias("val"))
    done = bf.write_block_files(df, f"file://{tmp_path}/a", "zlib", level=1, block_size=1024, levels=2, partitions=1)
    low, high = (100).to_bytes(4, "big"), (199).to_bytes(4, "big")
    assert sorted(map(str, bf.read_block_files(spark, f"{tmp_path}/a", low, high, direct=True).collect())) == sorted(map(str, bf.read_block_files(spark, f"{tmp_path}/a", low, high).collect()))
    assert bf.footers(spark, f"{tmp_path}/a", direct=True).collect() == bf.footers(spark, f"{tmp_path}/a").collect()
    data = bf.Ranged(done.first().file)
    assert len(list(bf.entries_of(data, low, high))) == 100 and data.read < len(data) / 20


def test_spark(spark, tmp_path):
    df = spark.range(5000).select(keys.be_u32(F.col("id")).alias("key"), keys.be_u32(F.col("id") * 3).alias("val"))
    done = bf.write_block_files(df, f"file://{tmp_path}/a", "snappy", block_size=2048, levels=1, partitions=3)
    assert done.count() == 3 and done.agg(F.sum("entries")).first()[0] == 5000
    back = bf.read_block_files(spark, f"{tmp_path}/a")
    assert back.select("key", "val").exceptAll(df).count() == 0 and back.count() == 5000
    some = bf.read_block_files(spark, f"{tmp_path}/a", (100).to_bytes(4, "big"), (199).to_bytes(4, "big"))
    assert some.count() == 100
    meta = bf.footers(spark, f"{tmp_path}/a").collect()
    assert {(r.version, r.compression, r.index_levels) for r in meta} == {(2, "snappy", 1)} and sum(r.entries for r in meta) == 5000
    twice = Merger.builder(CONCAT_BYTES).add(back.select("key", "val")).add(some.select("key", "val")).build().merged()
    assert twice.where("length(val) = 8").count() == 100
    with pytest.raises(Exception, match="does not stand above"):
        bf.write_block_files(df.union(df), f"file://{tmp_path}/b")
