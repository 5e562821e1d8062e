"""Merge functions: how the values of one key become one value.

A merge function must be associative and leave a single value as it is, for partial results are merged
again. A declarative one is an aggregate, which Spark combines on the map side; any Python function can be
used by MergeUdf, which hands it each key's values, in order, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratakv.errors import MergeError

Order = Column | None


@dataclass(frozen=True)
class Merge:
    """fold(value, order) is the aggregate; order is a column or struct that says in which order values arrived, None if that is not kept."""

    name: str
    fold: Callable[[Column, Order], Column]
    ordered: bool = False

    def aggregate(self, value: Column, order: Order) -> Column:
        if self.ordered and order is None:
            raise MergeError(f"{self.name} needs the order of values")
        return self.fold(value, order)

    def finish(self, key: Column, folded: Column, again: bool = False) -> Column:
        """again: what is folded are results of this very merge."""
        return folded


@dataclass(frozen=True)
class MergeUdf(Merge):
    """merge(key, values) in Python, values in order. Also called on single values, but not on a single result of its own."""

    function: Callable[[bytes, list[bytes]], bytes] = lambda key, values: values[0]
    returns: str = "binary"

    def finish(self, key: Column, folded: Column, again: bool = False) -> Column:
        function, name = self.function, self.name

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for keys, values in batches:
                try:
                    yield pd.Series([v[0] if again and len(v) == 1 else function(k, list(v)) for k, v in zip(keys, values, strict=True)], dtype=object)
                except Exception as e:
                    raise MergeError(f"merge function {name} failed: {e}") from e

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, self.returns)(key, folded)


def in_order(value: Column, order: Order) -> Column:
    """The values of a key as an array, in order."""
    if order is None:
        return F.collect_list(value)
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def udf(function: Callable[[bytes, list[bytes]], bytes], name: str = "udf", returns: str = "binary") -> MergeUdf:
    return MergeUdf(name, in_order, False, function, returns)


def _wrapping(value: Column, order: Order) -> Column:
    """Modulo 2 ** 32 without overflow: high and low halves are summed apart."""
    v = value.cast("long")
    low, high = F.sum(v.bitwiseAND(0xFFFF)), F.sum(F.shiftright(v, 16).bitwiseAND(0xFFFF))
    return F.pmod(low + F.pmod(high, F.lit(1 << 16)) * (1 << 16), F.lit(1 << 32))


FIRST = Merge("first", lambda v, o: F.min_by(v, o), True)
LAST = Merge("last", lambda v, o: F.max_by(v, o), True)
MIN = Merge("min", lambda v, o: F.min(v))
MAX = Merge("max", lambda v, o: F.max(v))
SUM = Merge("sum", lambda v, o: F.sum(v))
SUM_U32 = Merge("sum_u32", _wrapping)
COUNT = Merge("count", lambda v, o: F.sum(v.cast("long")))
BIT_OR = Merge("bit_or", lambda v, o: F.bit_or(v))
CONCAT = Merge("concat", lambda v, o: F.array_join(in_order(v, o), ""), True)
CONCAT_BYTES = Merge("concat_bytes", lambda v, o: F.unhex(F.array_join(F.transform(in_order(v, o), F.hex), "")), True)
SET_UNION = Merge("set_union", lambda v, o: F.array_join(F.array_sort(F.collect_set(v)), ","))


def either(first: Merge, second: Merge, use_first: bool) -> Merge:
    """One of two merge functions, chosen when the plan is made."""
    return first if use_first else second


def check_contract(function: Callable[[bytes, list[bytes]], bytes], samples: Sequence[Sequence[bytes]], key: bytes = b"key") -> None:
    """Raises MergeError unless merging single values leaves them and merging in parts gives what merging at once does."""
    for values in map(list, samples):
        for v in values:
            if function(key, [v]) != v:
                raise MergeError(f"a single value {v!r} does not stay as it is")
        whole = function(key, values) if values else None
        for at in range(1, len(values)):
            if function(key, [function(key, values[:at]), function(key, values[at:])]) != whole:
                raise MergeError(f"merging {values!r} in parts cut at {at} differs from merging at once")
