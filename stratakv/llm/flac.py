"""Lossless media columns: a FLAC encoder and decoder for 8-bit mono samples, on numpy.

Decoding is vectorised over frames: all frames of a batch are walked in lockstep, so each step reads one Rice
code and applies one linear prediction in every frame still open. Header CRC-8 and frame CRC-16 are verified. The decoder
gives PCM blocks with their sample offsets, and the encoder writes a seek table, so one block can be read alone.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import lean, slices, texts

#: Samples of a frame, and the unit that payloads are padded to.
BLOCK = 4096
UNIT = 192
RATE = 8000
#: Order and coefficient bits of the linear predictor that the encoder tries besides the fixed ones.
ORDER = 6
PRECISION = 12
#: Weights of the fixed predictors of order 0 to 4, as the format defines them.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class FlacError(ValueError):
    """The stored bytes are not what the encoder wrote."""


# ---------------------------------------------------------------- checksums


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[b] = c
    return out


CRC8 = _crc_table(8, 0x07)
CRC16 = _crc_table(16, 0x8005)
#: Row d: what each byte value adds to a CRC-16 when d bytes follow it.
_FAR = [CRC16]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _far(n: int) -> np.ndarray:
    table = _FAR[0] if _FAR[0].ndim == 2 else _FAR[0][None]
    if len(table) < n:
        rows = np.empty((max(n, 2 * len(table)), 256), dtype=np.uint32)
        rows[: len(table)] = table
        for d in range(len(table), len(rows)):
            c = rows[d - 1]
            rows[d] = ((c << 8) & 0xFFFF) ^ CRC16[c >> 8]
        table = rows
    _FAR[0] = table
    return table


def crc16(data: np.ndarray) -> int:
    """By linearity: each byte's share depends on its distance from the end only."""
    n = len(data)
    table = _far(n)
    return int(np.bitwise_xor.reduce(table.ravel()[np.arange(256 * (n - 1), -1, -256) + data])) if n else 0


# ---------------------------------------------------------------- encoder


def coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * k & 0x3F for k in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])


def bits_of(value: int, width: int) -> np.ndarray:
    return (value >> np.arange(width - 1, -1, -1)) & 1


def rice_bits(folded: np.ndarray, k: int) -> int:
    return int((folded >> k).sum()) + len(folded) * (k + 1)


def best_rice(folded: np.ndarray) -> tuple[int, int]:
    """(bits, parameter) of the cheapest Rice code."""
    guess = max(0, int(np.log2(folded.mean() + 1e-9))) if len(folded) else 0
    return min((rice_bits(folded, k), k) for k in range(max(0, guess - 1), min(14, guess + 1) + 1))


def fold(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 63)


def predictor(samples: np.ndarray) -> tuple[list[int], int] | None:
    """Quantised coefficients and shift by the autocorrelation method; None if there is nothing to predict.

    Exact lags and the recursion in plain floats: the same bytes on every machine.
    """
    n = len(samples)
    lags = [int(samples[: n - k] @ samples[k:]) for k in range(ORDER + 1)]
    left, weights = float(lags[0]) * (1 + 1e-9), [0.0] * ORDER
    for i in range(ORDER):
        if left <= 0:
            return None
        mirror = (lags[i + 1] - sum(weights[j] * lags[i - j] for j in range(i))) / left
        weights[: i + 1] = [weights[j] - mirror * weights[i - 1 - j] for j in range(i)] + [mirror]
        left *= 1 - mirror * mirror
    most = max(map(abs, weights))
    if not 1e-6 < most < 100:
        return None
    shift = min(15, PRECISION - 1 - math.frexp(most)[1])
    limit = (1 << (PRECISION - 1)) - 1
    return [max(-limit - 1, min(limit, round(w * (1 << shift)))) for w in weights], shift


def predicted(samples: np.ndarray, weights: list[int], shift: int) -> np.ndarray:
    order, n = len(weights), len(samples)
    total = np.zeros(n - order, dtype=np.int64)
    for k, c in enumerate(weights):
        total += c * samples[order - 1 - k : n - 1 - k]
    return total >> shift


def subframe(samples: np.ndarray) -> np.ndarray:
    """The bits of the cheapest subframe for one channel of 8-bit samples."""
    n = len(samples)
    if (samples == samples[0]).all():
        return np.concatenate([bits_of(0, 8), bits_of(int(samples[0]) & 0xFF, 8)])
    verbatim = 8 + 8 * n
    options: list[tuple[int, int, list[int], int, np.ndarray]] = []
    steps = [samples]
    while len(steps) < len(FIXED) and len(steps[-1]) > 1:
        steps.append(np.diff(steps[-1]))
    order = min(range(len(steps)), key=lambda k: int(np.abs(steps[k]).sum()))
    folded = fold(steps[order])
    bits, k = best_rice(folded)
    options.append((8 + 8 * order + 10 + bits, k, FIXED[order], -1, folded))
    if n > 4 * ORDER and (linear := predictor(samples)):
        folded = fold(samples[ORDER:] - predicted(samples, *linear))
        bits, k = best_rice(folded)
        options.append((8 + 8 * ORDER + 9 + PRECISION * ORDER + 10 + bits, k, *linear, folded))
    size, k, weights, shift, folded = min(options, key=lambda o: o[0])
    if size >= verbatim:
        return np.concatenate([bits_of(2, 8), np.unpackbits((samples & 0xFF).astype(np.uint8))])
    order = len(weights)
    kind = 8 + order if shift < 0 else 32 + order - 1
    head = [bits_of(kind << 1, 8), np.unpackbits((samples[:order] & 0xFF).astype(np.uint8))]
    if shift >= 0:
        head += [bits_of(PRECISION - 1, 4), bits_of(shift, 5), *[bits_of(c & ((1 << PRECISION) - 1), PRECISION) for c in weights]]
    head += [bits_of(0, 2), bits_of(0, 4), bits_of(k, 4)]
    quotient = folded >> k
    ends = np.cumsum(quotient + k + 1)
    body = np.zeros(int(ends[-1]), dtype=np.uint8)
    body[ends - k - 1] = 1
    for b in range(k):
        body[ends - k + b] = folded >> (k - 1 - b) & 1
    return np.concatenate([*head, body])


def frame(samples: np.ndarray, number: int) -> bytes:
    header = b"\xff\xf8" + bytes([7 << 4 | 4, 0 << 4 | 1 << 1]) + coded_number(number) + struct.pack(">H", len(samples) - 1)
    header += bytes([crc8(header)])
    body = header + np.packbits(subframe(samples).astype(np.uint8)).tobytes()
    return body + struct.pack(">H", crc16(np.frombuffer(body, dtype=np.uint8)))


def encode(payload: bytes, block: int = BLOCK) -> bytes:
    """A FLAC stream whose samples are the payload's bytes less 128; the last frame takes what remains."""
    samples = (np.frombuffer(payload, dtype=np.uint8) ^ 128).view(np.int8)
    frames = [frame(samples[at : at + block].astype(np.int64), number) for number, at in enumerate(range(0, len(samples), block))]
    sizes = [len(x) for x in frames]
    info = struct.pack(">HH", block, block) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    points = b"".join(struct.pack(">QQH", k * block, int(offsets[k]), min(block, len(samples) - k * block)) for k in range(len(frames)))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(frames)


# ---------------------------------------------------------------- decoder


@dataclass
class Stream:
    """What the metadata says, and where the frames are: (first sample, first byte, samples)."""

    total: int
    bits: int
    md5: bytes
    points: list[tuple[int, int, int]]


def parse(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, info, points = 4, False, b"", []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata breaks off")
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        last, body = bool(data[at] >> 7), data[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    if len(info) != 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    total, bits = packed & ((1 << 36) - 1), (packed >> 36 & 31) + 1
    if (packed >> 41 & 7) + 1 != 1 or bits != 8:
        raise FlacError("only mono streams of 8-bit samples are read")
    if sum(p[2] for p in points) != total:
        raise FlacError("the seek table does not cover the samples")
    return Stream(total, bits, info[18:34], [(s, at + o, n) for s, o, n in points])


class Words:
    """Bits at any position of a byte string, for many positions at once."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        self.n = len(data)
        self.by_byte = np.lib.stride_tricks.as_strided(self.data[:8].view(">u8"), shape=(self.n + 8,), strides=(1,)).astype(np.uint64)

    def at(self, bit: np.ndarray) -> np.ndarray:
        """The 57 bits from each position on, at the top of 64."""
        return self.by_byte[np.minimum(bit >> 3, self.n)] << (bit & 7).astype(np.uint64)

    def take(self, bit: int, width: int) -> int:
        some = int.from_bytes(self.data[bit >> 3 : (bit + width + 7) >> 3].tobytes(), "big")
        return some >> (-(bit + width) & 7) & ((1 << width) - 1)


#: Zeros before the first one in 16 bits; 16 for none.
_ZEROS = np.full(1 << 16, 16, dtype=np.int64)
for _bit in range(16):
    _ZEROS[1 << _bit : 2 << _bit] = 15 - _bit


def rice_codes(words: Words, bit: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded residual, bit after it) of the Rice codes with parameters k at the positions."""
    window = words.at(bit)
    zeros = _ZEROS[(window >> np.uint64(48)).astype(np.int64)]
    low = window << (zeros + 1).astype(np.uint64)
    far = np.flatnonzero(zeros == 16)
    open_ = far
    while len(open_):
        more = bit[open_] + zeros[open_]
        if (more >= 8 * words.n).any():
            raise FlacError("a unary code runs over the end")
        some = _ZEROS[(words.at(more) >> np.uint64(48)).astype(np.int64)]
        zeros[open_] += some
        open_ = open_[some == 16]
    if len(far):
        low[far] = words.at(bit[far] + zeros[far] + 1)
    folded = (zeros << k) | ((low >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64)
    return folded, bit + zeros + 1 + k


@dataclass
class Open:
    """A subframe whose residuals are still to be read."""

    row: int
    bit: int
    order: int
    weights: list[int]
    shift: int
    parts: list[int]
    wide: int
    n: int


def open_frame(data: bytes, words: Words, first: int, base: int, size: int, expected: int, row: int, out: np.ndarray) -> tuple[Open | None, int]:
    """Reads a frame's headers. Gives what is left to decode, or the bit where the frame's samples end."""
    if data[first : first + 2] != b"\xff\xf8":
        raise FlacError("no frame where the seek table says")
    code, at = data[first + 2] >> 4, first + 4
    at += 1 if data[at] < 0x80 else (8 - (~data[at] & 0xFF).bit_length())
    n = {6: lambda: data[at] + 1, 7: lambda: int.from_bytes(data[at : at + 2], "big") + 1}.get(code, lambda: 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8 if code >= 8 else 192)()
    at += {6: 1, 7: 2}.get(code, 0)
    if crc8(data[first:at]) != data[at]:
        raise FlacError("the checksum of a frame header is wrong")
    if n != expected:
        raise FlacError("a frame's length differs from the seek table")
    bit = (base + at + 1) * 8
    head = words.take(bit, 8)
    kind, bit = head >> 1 & 63, bit + 8
    if head & 1:
        raise FlacError("wasted bits are not read")

    def signed(width: int) -> int:
        nonlocal bit
        v = words.take(bit, width)
        bit += width
        return v - (1 << width) if v >> (width - 1) else v

    if kind == 0:
        out[row, :n] = signed(8)
        return None, bit
    if kind == 1:
        out[row, :n] = words.data[bit // 8 : bit // 8 + n].view(np.int8)
        return None, bit + 8 * n
    if 8 <= kind <= 12:
        order, weights, shift = kind - 8, FIXED[kind - 8], 0
        out[row, :order] = [signed(8) for _ in range(order)]
    elif kind >= 32:
        order = kind - 31
        out[row, :order] = [signed(8) for _ in range(order)]
        precision = words.take(bit, 4) + 1
        bit += 4
        shift = signed(5)
        weights = [signed(precision) for _ in range(order)]
    else:
        raise FlacError("an unknown kind of subframe")
    method, parts = words.take(bit, 2), words.take(bit + 2, 4)
    if method > 1 or shift < 0:
        raise FlacError("an unknown residual coding")
    return Open(row, bit + 6, order, weights, shift, [(n >> parts) - (order if p == 0 else 0) for p in range(1 << parts)], 4 + method, n), 0


def decode_frames(data: bytes, spans: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Samples of the frames at (first byte, end byte, samples) of data, all read in lockstep."""
    raw = np.frombuffer(data, dtype=np.uint8)
    words = Words(raw)
    out = np.zeros((len(spans), max((s[2] for s in spans), default=0)), dtype=np.int16)
    ends = np.zeros(len(spans), dtype=np.int64)
    left: list[Open] = []
    for row, (first, end, n) in enumerate(spans):
        if crc16(raw[first : end - 2]) != int.from_bytes(data[end - 2 : end], "big"):
            raise FlacError("the checksum of a frame is wrong")
        job, done = open_frame(data, words, first, 0, end - first, n, row, out)
        if job:
            left.append(job)
        ends[row] = done
    if left:
        left.sort(key=lambda j: -(j.n - j.order))
        walk(words, left, out, ends)
    for (_, end, _n), bit in zip(spans, ends, strict=True):
        if -(-bit // 8) != end - 2:
            raise FlacError("a frame's samples end elsewhere than the frame")
    return [out[row, : s[2]].astype(np.int8) for row, s in enumerate(spans)]


def walk(words: Words, jobs: list[Open], out: np.ndarray, ends: np.ndarray) -> None:
    """One sample of every open frame a step. jobs: longest first, so that the open ones are always a prefix."""
    most = max(1, max(j.order for j in jobs))
    bit = np.array([j.bit for j in jobs])
    shift = np.array([j.shift for j in jobs])
    todo = np.array([j.n - j.order for j in jobs])
    weights = np.zeros((most, len(jobs)), dtype=np.int64)  # of the oldest sample first
    made = np.zeros((most + int(todo[0]), len(jobs)), dtype=np.int64)
    begins: dict[int, list[int]] = {}
    for k, j in enumerate(jobs):
        weights[most - j.order :, k] = j.weights[::-1]
        made[most - j.order : most, k] = out[j.row, : j.order]
        at = 0
        for n in j.parts:
            begins.setdefault(at, []).append(k)
            at += n
    rice = np.zeros(len(jobs), dtype=np.int64)
    m = len(jobs)
    for step in range(int(todo[0])):
        while todo[m - 1] <= step:
            m -= 1
        for k in begins.get(step, ()):  # a partition may be empty, and then another follows at once
            if k < m:
                wide = jobs[k].wide
                rice[k] = words.take(int(bit[k]), wide)
                bit[k] += wide
                if rice[k] == (1 << wide) - 1:
                    raise FlacError("unencoded partitions are not read")
        folded, bit[:m] = rice_codes(words, bit[:m], rice[:m])
        total = (weights[:, :m] * made[step : step + most, :m]).sum(axis=0) >> shift[:m]
        made[step + most, :m] = total + ((folded >> 1) ^ -(folded & 1))
    for k, j in enumerate(jobs):
        out[j.row, j.order : j.n] = made[most : most + j.n - j.order, k]
        ends[j.row] = bit[k]


def decode_many(streams: list[bytes], frames_at_once: int = 2048, samples_at_once: int = 8 << 20) -> list[bytes]:
    """The samples of each stream, plus 128, as bytes; lengths, checksums and the stream's MD5 are verified. Frames are read in lockstep, of the lengths of the longest samples_at_once together."""
    infos = [parse(x) for x in streams]
    pieces: list[list[np.ndarray]] = [[] for _ in streams]
    batch: list[tuple[int, int, int, int]] = []

    def flush() -> None:
        base, spans, data = 0, [], []
        for s, first, end, n in batch:
            data.append(streams[s][first:end])
            spans.append((base, base + end - first, n))
            base += end - first
        for (s, *_), samples in zip(batch, decode_frames(b"".join(data), spans), strict=True):
            pieces[s].append(samples)
        batch.clear()

    longest = 0
    for s, info in enumerate(infos):
        stops = [p[1] for p in info.points[1:]] + [len(streams[s])]
        for (_, first, n), end in zip(info.points, stops, strict=True):
            longest = max(longest, n) if batch else n
            batch.append((s, first, end, n))
            if len(batch) >= frames_at_once or len(batch) * longest >= samples_at_once:
                flush()
    if batch:
        flush()
    out = []
    for info, some in zip(infos, pieces, strict=True):
        samples = np.concatenate([np.empty(0, dtype=np.int8), *some])
        some.clear()
        if hashlib.md5(samples).digest() != info.md5:
            raise FlacError("the stream's MD5 is wrong")
        out.append((samples.view(np.uint8) ^ 128).tobytes())
    return out


def blocks(stream: bytes) -> Iterator[tuple[int, bytes]]:
    """(sample offset, PCM bytes) of each frame, read alone by the seek table."""
    info = parse(stream)
    stops = [p[1] for p in info.points[1:]] + [len(stream)]
    for (first, at, n), end in zip(info.points, stops, strict=True):
        yield first, (decode_frames(stream[at:end], [(0, end - at, n)])[0].view(np.uint8) ^ 128).tobytes()


# ---------------------------------------------------------------- distributed


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * ((max(1, -(-len(text) // UNIT))) * UNIT - len(text))


def by_samples(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose media decode to about `most` samples; a longer row stands alone. A stream's first block says how many it has."""
    size = [int.from_bytes(x[18:26], "big") & ((1 << 36) - 1) for x in batch.column(column).to_pylist()]
    at = 0
    while at < len(size):
        upto, total = at, 0
        while upto < len(size) and (upto == at or total + size[upto] <= most):
            total += size[upto]
            upto += 1
        yield batch.slice(at, upto - at)
        at = upto


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text as a FLAC stream. Null texts count as empty; rows keep their number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                raw = texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], type=pa.int64()), pa.array([encode(padded(x)) for x in raw], type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, media binary")


def pcm(stored: DataFrame) -> DataFrame:
    """(doc_id, block int, sample_offset long, pcm binary): a row for each frame, in seekable blocks. Null media give none; one block alone is read by blocks()."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (y for x in slices(batch.filter(pc.is_valid(batch.column(1))), 6 << 20) for y in by_samples(x, 1)):
                media = part.column(1).to_pylist()
                found = [(row, n, first, payload[first : first + size]) for row, (stream, payload) in enumerate(zip(media, decode_many(media), strict=True)) for n, (first, _, size) in enumerate(parse(stream).points)]
                rows, numbers, offsets, samples = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int64()), pa.array(samples, pa.binary())], names=["doc_id", "block", "sample_offset", "pcm"])

    return stored.select("doc_id", "media").mapInArrow(lean(run), f"doc_id {kind}, block int, sample_offset long, pcm binary")


def feature(payload: bytes) -> str:
    """Peak, mean, energy, sign changes about the mean, and mean step, as integers: the same on every machine."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int16) - np.int16(128)  # squares of such samples fit too
    mean = int(x.sum(dtype=np.int64)) // len(x)
    above = x > mean
    return f"peak={int(np.abs(x).max())};mean={mean};energy={int((x * x).sum(dtype=np.int64)) // len(x)};crossings={int((above[1:] != above[:-1]).sum())};step={int(np.abs(np.diff(x)).sum(dtype=np.int64)) // len(x)}"


def features(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of what the media decode to."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (y for x in slices(batch, 6 << 20) for y in by_samples(x, 2)):
                media = part.column(2).to_pylist()
                payloads = decode_many(media)
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array([len(x) for x in payloads], type=pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                    pa.array([zlib.crc32(x[-16:]) for x in payloads], type=pa.int64()),
                    pa.array([len(x) for x in media], type=pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                    pa.array([feature(x) for x in payloads]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
