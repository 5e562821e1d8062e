"""Codecs by name and number, and the Parquet codec that stands for each."""

from __future__ import annotations

from enum import Enum

from stratakv.errors import InvalidCompressionType


class Codec(Enum):
    """value: (number in block files, name, Parquet codec)."""

    NONE = (0, "none", "uncompressed")
    SNAPPY_PRE_05 = (1, "snappy-pre-0.5", "snappy")
    ZLIB = (2, "zlib", "gzip")
    LZ4 = (3, "lz4", "lz4_raw")
    ZSTD = (4, "zstd", "zstd")
    SNAPPY = (5, "snappy", "snappy")

    @property
    def number(self) -> int:
        return self.value[0]

    @property
    def label(self) -> str:
        return self.value[1]

    @property
    def parquet(self) -> str:
        return self.value[2]

    @staticmethod
    def parse(name: str | Codec) -> Codec:
        if isinstance(name, Codec):
            return name
        for codec in Codec:
            if name == codec.label or name == "uncompressed" and codec is Codec.NONE:
                return codec
        raise InvalidCompressionType(f"no codec is named {name!r}")

    @staticmethod
    def of_number(number: int) -> Codec:
        for codec in Codec:
            if codec.number == number:
                return codec
        raise InvalidCompressionType(f"no codec has number {number}")

    def level_options(self, level: int) -> dict[str, str]:
        """Parquet writer options for a level; codecs without levels ignore it, and so does level 0, which stands for the default."""
        if level and self is Codec.ZSTD:
            return {"parquet.compression.codec.zstd.level": str(level)}
        if level and self is Codec.ZLIB:
            return {"zlib.compress.level": {1: "BEST_SPEED", 2: "TWO", 3: "THREE", 4: "FOUR", 5: "FIVE", 6: "SIX", 7: "SEVEN", 8: "EIGHT"}.get(level, "BEST_COMPRESSION")}
        return {}
