import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratakv.llm import flac
from stratakv.llm.queries import QUERIES


def samples(rng):
    kind = rng.randrange(5)
    n = rng.choice([1, 5, 16, 192, 4095, 4096, 4097, 9000])
    if kind == 0:
        return bytes([rng.randrange(256)]) * n
    if kind == 1:
        return rng.randbytes(n)
    if kind == 2:
        return (np.sin(np.arange(n) / 9) * 100 + 128).astype(np.uint8).tobytes()
    if kind == 3:
        return (np.cumsum(np.random.default_rng(n).integers(-2, 3, n)) % 256).astype(np.uint8).tobytes()
    return (b"some words of a text, and more. " * (n // 32 + 1))[:n]


def test_round_trip():
    rng = random.Random(4)
    payloads = [samples(rng) for _ in range(120)]
    streams = [flac.encode(x) for x in payloads]
    assert flac.decode_many(streams, 7) == payloads
    for x, s in zip(payloads[:30], streams, strict=False):
        found = list(flac.blocks(s))
        assert b"".join(b for _, b in found) == x
        assert [o for o, _ in found] == list(range(0, len(x), flac.BLOCK))


class Bits:
    def __init__(self, data):
        self.bits, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n):
        self.left -= n
        return self.bits >> self.left & ((1 << n) - 1)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_residual(b, size, order):
    wide = 4 if b.take(2) == 0 else 5
    parts = 1 << b.take(4)
    out = []
    for part in range(parts):
        rice = b.take(wide)
        assert rice != (1 << wide) - 1
        for _ in range(size // parts - (order if part == 0 else 0)):
            v = b.zeros() << rice | b.take(rice)
            out.append(v >> 1 ^ -(v & 1))
    return out


def plain_frame(b):
    """Samples of one frame of one 8-bit channel, bit by bit."""
    began = b.left
    assert b.take(14) == 0x3FFE
    b.take(2)
    code, rate = b.take(4), b.take(4)
    assert b.take(4) == 0 and b.take(3) in (0, 1)
    b.take(1)
    first = b.take(8)
    if first >= 128:  # its leading ones count the bytes of the frame's number
        b.take(8 * (7 - (first ^ 0xFF).bit_length()))
    size = {6: lambda: b.take(8) + 1, 7: lambda: b.take(16) + 1, 1: lambda: 192}.get(code, lambda: 576 << (code - 2) if code < 6 else 256 << (code - 8))()
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0) + 8)
    assert b.take(1) == 0
    kind = b.take(6)
    assert b.take(1) == 0
    if kind == 0:
        x = [b.signed(8)] * size
    elif kind == 1:
        x = [b.signed(8) for _ in range(size)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        x = [b.signed(8) for _ in range(order)]
        if kind < 32:
            factors, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            bits = b.take(4) + 1
            shift = b.signed(5)
            factors = [b.signed(bits) for _ in range(order)]
        for r in plain_residual(b, size, order):
            x.append(r + (sum(f * v for f, v in zip(factors, x[::-1], strict=False)) >> shift))
    b.take((b.left - began) % 8)
    b.take(16)
    return x


def plain_decode(stream):
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, size = bool(stream[at] & 128), int.from_bytes(stream[at + 1 : at + 4], "big")
        at += 4 + size
    b = Bits(stream[at:])
    out = []
    while b.left:
        out += plain_frame(b)
    return bytes(v + 128 for v in out)


def test_streams_are_read_by_a_plain_decoder():
    """Every kind of frame that is written, by the format alone."""
    rng = random.Random(11)
    for _ in range(60):
        x = samples(rng)
        assert plain_decode(flac.encode(x)) == x


def test_all_subframes_are_used():
    kinds = set()
    rng = random.Random(4)
    for _ in range(200):
        x = np.frombuffer(samples(rng), dtype=np.uint8).astype(np.int64) - 128
        bits = flac.subframe(x[:4096])
        kinds.add(int(np.packbits(bits[:8])[0]) >> 1)
    assert {0, 1} <= kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)


def crc(data, bits, poly):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def test_checksums():
    rng = random.Random(1)
    for n in (1, 2, 30, 700):
        data = rng.randbytes(n)
        assert flac.crc8(data) == crc(data, 8, 0x07)
        assert flac.crc16(np.frombuffer(data, dtype=np.uint8)) == crc(data, 16, 0x8005)


def test_damage_is_found():
    stream = bytearray(flac.encode(flac.padded(b"words and more words " * 500)))
    for at in (5, 60, 120, 900, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 4
        if at == 5:
            continue
        with pytest.raises(flac.FlacError):
            flac.decode_many([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode_many([bytes(stream[:-50])])


def plain(text):
    raw = (text or "").encode()
    padded = raw + b" " * (-len(raw) % 192 if raw else 192)
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    made = QUERIES["op5_media_flac"](spark, sf).collect()
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in made}
    assert got == {r.doc_id: plain(r.text) for r in rows}
    texts = {r.doc_id: (r.text or "").encode() for r in rows}
    assert all(r.feature == plain_feature(texts[r.doc_id] + b" " * (r.payload_bytes - r.n_bytes)) for r in made)


def test_edge_rows(spark):
    rows = [(1, None, b"x"), (1, "", b"x"), (None, "été", b"x"), (2, "a" * 192, b"x"), (2, "a" * 192, b"x"), (3, "wörter " * 40_000, b"x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    stored = flac.store(df)
    got = flac.features(stored).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((str(d), *plain(t)) for d, t, _ in rows)
    media = {(r.doc_id, r.n_bytes): r.media for r in stored.collect()}
    assert all(hashlib.sha256(media[r.doc_id, r.n_bytes]).hexdigest() == r.media_sha256 and len(media[r.doc_id, r.n_bytes]) == r.media_bytes for r in got)
    long = flac.pcm(stored).where("doc_id = 3").orderBy("block").collect()
    assert b"".join(r.pcm for r in long).rstrip() == rows[-1][1].encode().rstrip()
    assert [r.sample_offset for r in long] == [k * flac.BLOCK for k in range(len(long))]
    assert flac.features(flac.store(df.where("false"))).count() == 0 and flac.pcm(stored.where("false")).count() == 0


def test_slices_are_of_bounded_samples():
    """Texts that take next to no media are cut by what they decode to."""
    payloads = [flac.padded(bytes([97 + k % 20]) * 96_000) for k in range(400)]
    media = [flac.encode(x) for x in payloads]
    assert sum(map(len, media)) < 1 << 20
    batch = pa.RecordBatch.from_arrays([pa.array(media, pa.binary())], names=["media"])
    parts = list(flac.by_samples(batch, 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == media and len(parts) == 5
    tracemalloc.start()
    for at, part in enumerate(parts[:2]):
        assert flac.decode_many(part.column(0).to_pylist()) == payloads[87 * at : 87 * at + part.num_rows]
    assert tracemalloc.get_traced_memory()[1] < 160 << 20
    tracemalloc.stop()
    assert [p.num_rows for p in flac.by_samples(batch.slice(0, 3), 0, 1)] == [1, 1, 1] and not list(flac.by_samples(batch.slice(0, 0), 0))


def plain_feature(payload):
    x = [b - 128 for b in payload]
    mean = sum(x) // len(x)
    over = [v > mean for v in x]
    steps = sum(abs(a - b) for a, b in zip(x, x[1:])) // len(x)
    return f"peak={max(map(abs, x))};mean={mean};energy={sum(v * v for v in x) // len(x)};crossings={sum(a != b for a, b in zip(over, over[1:]))};step={steps}"


def test_feature_by_hand():
    payload = bytes([0, 255, 128, 130, 130])
    assert flac.feature(payload) == plain_feature(payload)
