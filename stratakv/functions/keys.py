"""Encoders of keys and values as JVM expressions, and the prefix bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_u64(x: Column) -> Column:
    """8 bytes, most significant first, so that unsigned numbers sort as bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def be_u32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))


def be_i64(x: Column) -> Column:
    """Signed numbers with the sign bit turned, so that negative ones sort first."""
    return be_u64(x.cast("long").bitwiseXOR(F.lit(-(1 << 63))))


def be_i32(x: Column) -> Column:
    return be_u32(x.cast("long") + F.lit(1 << 31))


def utf8(x: Column) -> Column:
    return F.encode(x, "UTF-8")


def from_be(x: Column) -> Column:
    """The unsigned number of up to 7 bytes, or the signed one of 8."""
    return F.conv(F.hex(x), 16, -10).cast("long")


def from_be_i64(x: Column) -> Column:
    return from_be(x).bitwiseXOR(F.lit(-(1 << 63)))


def from_be_i32(x: Column) -> Column:
    return from_be(x) - F.lit(1 << 31)


def _turned(digits: Column) -> Column:
    return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])


def le_u32(x: Column) -> Column:
    """4 bytes, least significant first: a machine's own order of numbers."""
    return F.unhex(_turned(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")))


def from_le_u32(x: Column) -> Column:
    return F.conv(_turned(F.hex(x)), 16, 10).cast("long")


def after_prefix(prefix: bytes) -> bytes | None:
    """The smallest key above all that start with the prefix; None if there is none (no bytes, or all FF)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None
