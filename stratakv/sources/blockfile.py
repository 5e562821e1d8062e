"""Block files: the compact sorted key-value files that other engines exchange, read and written by Spark.

A file is a run of blocks, then an index tree of blocks of the same shape, then a footer. A block is its length
(8 bytes, big-endian) and its compressed payload: entries as (key length, value length, key, value) with lengths as
base-128 numbers, then the offsets of every n-th entry (8 bytes each, big-endian) and their count (4 bytes).
An index entry's key is the last key of its child, its value the child's offset. The footer is little-endian:
offset of the root, codec, number of entries, index levels below the root (version 2 only), magic number.

Files are read with Spark's binaryFile source, so from any store that Spark reads, a file in each task; with a range
of keys only blocks that overlap it are decompressed. So read, a file has to fit in a row, at most 2 GB. Where the workers can
open the files themselves (direct), they read the footer, the index and the blocks that overlap the range, and no more.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stratakv.errors import InvalidFormatVersion, KvError, OrderError
from stratakv.sources.codecs import Codec

# Fixed values of the format.
MAGIC_V1 = 0x76324D4C
MAGIC_V2 = 0x6723D4C4
FOOTER_V1, FOOTER_V2 = struct.Struct("<QBQI"), struct.Struct("<QBQBI")

BLOCK_SIZE, LEAST_BLOCK_SIZE, INTERVAL = 8192, 1024, 8


# ---------------------------------------------------------------- codecs

_SNAPPY_START = b"\xff\x06\x00\x00sNaPpY"


def _crc32c_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = table >> np.uint32(1) ^ np.where(table & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return table


_CRC32C = _crc32c_table()
#: Row d: what each byte value adds to the checksum when d bytes follow it.
_FAR = [_CRC32C[None]]


def _far(n: int) -> np.ndarray:
    table = _FAR[0]
    if len(table) < n:
        rows = np.empty((max(n, 2 * len(table)), 256), dtype=np.uint32)
        rows[: len(table)] = table
        for d in range(len(table), len(rows)):
            rows[d] = _CRC32C[rows[d - 1] & 0xFF] ^ rows[d - 1] >> np.uint32(8)
        _FAR[0] = table = rows
    return table


def crc32c(data: bytes, piece: int = 4096) -> int:
    """By linearity: a byte's share depends on its distance from the end of its piece only, and a piece takes what came before it in its first four bytes."""
    c = 0xFFFFFFFF
    for at in range(0, len(data), piece):
        some = np.frombuffer(data, dtype=np.uint8, count=min(piece, len(data) - at), offset=at)
        if len(some) < 4:
            for b in some.tolist():
                c = int(_CRC32C[(c ^ b) & 0xFF]) ^ c >> 8
            continue
        some = some.copy()
        some[:4] ^= np.frombuffer(c.to_bytes(4, "little"), dtype=np.uint8)
        c = int(np.bitwise_xor.reduce(_far(len(some)).ravel()[np.arange(256 * (len(some) - 1), -1, -256) + some]))
    return c ^ 0xFFFFFFFF


def masked_crc32c(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _raw_snappy(data: bytes) -> bytes:
    size, _ = varint(data, 0)
    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True) if size else b""


def compress(codec: Codec, level: int, data: bytes) -> bytes:
    if codec is Codec.NONE:
        return data
    if codec is Codec.ZLIB:
        return zlib.compress(data, min(level, 9))
    if codec is Codec.SNAPPY_PRE_05:
        return pa.compress(data, codec="snappy", asbytes=True)
    if codec is Codec.SNAPPY:
        out = [_SNAPPY_START]
        for at in range(0, len(data), 1 << 16):
            part = data[at : at + (1 << 16)]
            packed = pa.compress(part, codec="snappy", asbytes=True)
            out.append(b"\x00" + (len(packed) + 4).to_bytes(3, "little") + masked_crc32c(part).to_bytes(4, "little") + packed)
        return b"".join(out)
    sink = pa.BufferOutputStream()
    kind = pa.Codec("zstd", compression_level=level or None) if codec is Codec.ZSTD else pa.Codec("lz4")
    if codec is Codec.ZSTD:
        return kind.compress(data, asbytes=True)
    with pa.CompressedOutputStream(sink, "lz4") as stream:
        stream.write(data)
    return sink.getvalue().to_pybytes()


def decompress(codec: Codec, data: bytes) -> bytes:
    if codec is Codec.NONE:
        return data
    if codec is Codec.ZLIB:
        return zlib.decompress(data)
    if codec is Codec.SNAPPY_PRE_05:
        return _raw_snappy(data)
    if codec is Codec.SNAPPY:
        out, at = [], 0
        while at < len(data):
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
            body, at = data[at + 4 : at + 4 + size], at + 4 + size
            if kind in (0, 1):
                part = _raw_snappy(body[4:]) if kind == 0 else body[4:]
                if masked_crc32c(part) != int.from_bytes(body[:4], "little"):
                    raise KvError("the checksum of a snappy frame is wrong")
                out.append(part)
            elif 2 <= kind < 0x80:
                raise KvError(f"unknown snappy frame {kind}")
        return b"".join(out)
    with pa.CompressedInputStream(pa.BufferReader(data), "zstd" if codec is Codec.ZSTD else "lz4") as stream:
        return stream.read()


# ---------------------------------------------------------------- reading


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, offset behind it)."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def coded(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


@dataclass(frozen=True)
class Footer:
    version: int
    root: int
    codec: Codec
    entries: int
    levels: int


class Ranged:
    """The bytes of a file, read by slices."""

    def __init__(self, path: str) -> None:
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        store, place = pyarrow.fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        self.size = self.file.size()
        #: Bytes read so far.
        self.read = 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        self.read += max(0, stop - start)
        return self.file.read_at(max(0, stop - start), start)


Data = bytes | Ranged


def footer(data: Data) -> Footer:
    if len(data) < FOOTER_V1.size:
        raise InvalidFormatVersion("a file is shorter than a footer")
    magic = int.from_bytes(data[-4:], "little")
    if magic == MAGIC_V2 and len(data) >= FOOTER_V2.size:
        root, codec, entries, levels, _ = FOOTER_V2.unpack(data[-FOOTER_V2.size :])
        return Footer(2, root, Codec.of_number(codec), entries, levels)
    if magic == MAGIC_V1:
        root, codec, entries, _ = FOOTER_V1.unpack(data[-FOOTER_V1.size :])
        return Footer(1, root, Codec.of_number(codec), entries, 0)
    raise InvalidFormatVersion(f"no format version has the magic number {magic:#x}")


def block(data: Data, at: int, codec: Codec) -> Iterator[tuple[bytes, bytes]]:
    """The entries of the block at an offset."""
    size = int.from_bytes(data[at : at + 8], "big")
    payload = decompress(codec, data[at + 8 : at + 8 + size])
    offsets = int.from_bytes(payload[-4:], "big")
    end = len(payload) - 4 - 8 * offsets
    at = 0
    while at < end:
        klen, at = varint(payload, at)
        vlen, at = varint(payload, at)
        yield payload[at : at + klen], payload[at + klen : at + klen + vlen]
        at += klen + vlen


def entries_of(data: Data, low: bytes | None = None, high: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
    """Entries with low <= key <= high, in order; other blocks are not decompressed."""
    f = footer(data)

    def leaves(at: int, below: int, before: bytes | None) -> Iterator[int]:
        for last, child in block(data, at, f.codec):
            if (low is None or last >= low) and (high is None or before is None or before < high):
                where = int.from_bytes(child, "big")
                yield from leaves(where, below - 1, before) if below else (where,)
            before = last

    for at in leaves(f.root, f.levels, None):
        for k, v in block(data, at, f.codec):
            if (low is None or k >= low) and (high is None or k <= high):
                yield k, v


def files(spark: SparkSession, path: str, direct: bool) -> DataFrame:
    """(path, content) of all files at a path; with direct, their lengths instead of their contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length" if direct else "content")


def read_block_files(spark: SparkSession, path: str, low: bytes | None = None, high: bytes | None = None, direct: bool = False) -> DataFrame:
    """(key, val, file): the entries of all files at a path, as they stand in each. Merger merges them by file. direct: workers open the files."""
    shape = "key binary, val binary, file string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = Ranged(name) if direct else data
                held: list[tuple[bytes, bytes]] = []
                size = 0
                for k, v in entries_of(data, low, high):
                    held.append((k, v))
                    size += len(k) + len(v)
                    if size > 4 << 20 or len(held) >= 50_000:
                        yield rows(held, name)
                        held, size = [], 0
                if held:
                    yield rows(held, name)

    def rows(held: list[tuple[bytes, bytes]], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([v for _, v in held], pa.binary()), pa.array([name] * len(held))], names=["key", "val", "file"])

    return files(spark, path, direct).mapInArrow(run, shape)


def footers(spark: SparkSession, path: str, direct: bool = False) -> DataFrame:
    """(file, version, compression, entries, index_levels) of all files at a path. direct: workers open the files, and read the footers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [footer(Ranged(name) if direct else x) for name, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = [batch.column(0), pa.array([f.version for f in found], pa.int32()), pa.array([f.codec.label for f in found], pa.string()), pa.array([f.entries for f in found], pa.int64()), pa.array([f.levels for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "version", "compression", "entries", "index_levels"])

    return files(spark, path, direct).mapInArrow(run, "file string, version int, compression string, entries long, index_levels int")


# ---------------------------------------------------------------- writing


class BlockFile:
    """Collects ascending entries to the bytes of a file."""

    def __init__(self, codec: Codec = Codec.NONE, level: int = 0, block_size: int = BLOCK_SIZE, interval: int = INTERVAL, levels: int = 0) -> None:
        self.codec, self.level, self.levels, self.interval = codec, level, levels, interval
        self.block_size = max(LEAST_BLOCK_SIZE, block_size)
        self.out = io.BytesIO()
        self.count = 0
        #: Entries not yet written: of data first, then of index blocks from the leaves up; the last is the root.
        self.open: list[list[tuple[bytes, bytes]]] = [[] for _ in range(levels + 2)]
        self.sizes = [0] * (levels + 2)
        self.last: bytes | None = None

    def add(self, key: bytes, val: bytes) -> None:
        if self.last is not None and key <= self.last:
            raise OrderError(f"key {key!r} does not stand above {self.last!r}")
        self.last = key
        self.count += 1
        self.put(0, key, val)

    def put(self, depth: int, key: bytes, val: bytes) -> None:
        self.open[depth].append((key, val))
        self.sizes[depth] += len(key) + len(val) + len(coded(len(key))) + len(coded(len(val)))
        if self.sizes[depth] >= self.block_size and depth < len(self.open) - 1:
            self.close(depth)

    def close(self, depth: int) -> None:
        """Writes the open block of a depth, and tells the one above."""
        some = self.open[depth]
        self.open[depth], self.sizes[depth] = [], 0
        at = self.write(some)
        self.put(depth + 1, some[-1][0], at.to_bytes(8, "big"))

    def write(self, some: list[tuple[bytes, bytes]]) -> int:
        body, offsets = bytearray(), [0]
        for n, (k, v) in enumerate(some):
            if n and n % self.interval == 0:
                offsets.append(len(body))
            body += coded(len(k)) + coded(len(v)) + k + v
        packed = compress(self.codec, self.level, bytes(body) + b"".join(o.to_bytes(8, "big") for o in offsets) + len(offsets).to_bytes(4, "big"))
        at = self.out.tell()
        self.out.write(len(packed).to_bytes(8, "big") + packed)
        return at

    def finish(self) -> bytes:
        for depth in range(len(self.open) - 1):
            if self.open[depth]:
                self.close(depth)
        levels = self.levels if self.count else 0
        root = self.write(self.open[-1])
        self.out.write(FOOTER_V2.pack(root, self.codec.number, self.count, levels, MAGIC_V2))
        return self.out.getvalue()


def write_block_files(entries: DataFrame, uri: str, codec: str | Codec = Codec.NONE, level: int = 0, block_size: int = BLOCK_SIZE, interval: int = INTERVAL, levels: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes entries with unique keys to block files below a URI that all executors share, one for each range of keys; gives (file, entries), after writing.

    A file is named by its range's number, so no two are named alike, and appears under its name only when it is whole: a task
    that is run again leaves no half file, and its file takes the place of the same one.
    """
    spark, kind, run_id = entries.sparkSession, Codec.parse(codec), uuid.uuid4().hex[:8]
    rows = entries.select("key", "val")
    rows = (rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")).sortWithinPartitions("key")
    shape = "file string, entries long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = BlockFile(kind, level, block_size, interval, levels)
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made.add(k, v)
        if not made.count:
            return
        store, place = pyarrow.fs.FileSystem.from_uri(uri)
        store.create_dir(place, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{run_id}.blocks"
        half = f"{place}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(half) as stream:
            stream.write(made.finish())
        store.move(half, f"{place}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{place}/{name}"]), pa.array([made.count], pa.int64())], names=["file", "entries"])

    done = rows.mapInArrow(run, shape).collect()  # a row for each file
    return spark.createDataFrame([tuple(r) for r in done], shape)


