"""Entries: rows of a binary key and a binary value, neither null, ordered by unsigned bytes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KV = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("val", T.BinaryType(), False)])


class Kind(Enum):
    UNBOUNDED = "unbounded"
    INCLUDED = "included"
    EXCLUDED = "excluded"


@dataclass(frozen=True)
class Bound:
    """An end of a range: unbounded, included or excluded."""

    kind: Kind
    key: Any = None

    def above(self, key: Column) -> Column | None:
        """Keys allowed by this as a lower end; None for all."""
        return {Kind.UNBOUNDED: None, Kind.INCLUDED: key >= F.lit(self.key), Kind.EXCLUDED: key > F.lit(self.key)}[self.kind]

    def below(self, key: Column) -> Column | None:
        """Keys allowed by this as an upper end; None for all."""
        return {Kind.UNBOUNDED: None, Kind.INCLUDED: key <= F.lit(self.key), Kind.EXCLUDED: key < F.lit(self.key)}[self.kind]


UNBOUNDED = Bound(Kind.UNBOUNDED)


def included(key: Any) -> Bound:
    return Bound(Kind.INCLUDED, bytes(key) if isinstance(key, bytearray) else key)


def excluded(key: Any) -> Bound:
    return Bound(Kind.EXCLUDED, bytes(key) if isinstance(key, bytearray) else key)


def entries(df: DataFrame, key: Column | str = "key", val: Column | str = "val", *more: Column | str) -> DataFrame:
    """df as entries; a null key or value fails when the rows are read."""

    def sure(c: Column | str, name: str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(c, F.raise_error(F.lit(f"null {name}"))).alias(name)

    return df.select(sure(key, "key"), sure(val, "val"), *more)
