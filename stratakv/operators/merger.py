"""Merger: sorted sources in, one sorted run out; values of equal keys meet in the order of their sources."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.functions.merge import Merge, MergeUdf
from stratakv.operators.sorter import empty, fold

if TYPE_CHECKING:
    from stratakv.sources.store import Reader, Writer


@dataclass
class MergerBuilder:
    """Sources in order. Each is (key, val) with unique keys; if keys repeat inside one, a column seq may order them."""

    merge: Merge
    sources: list[tuple[DataFrame, Any]] = field(default_factory=list)

    def push(self, source: DataFrame, after_key: Any = None) -> None:
        """after_key: only entries behind it take part, as of a cursor that stands on it."""
        self.sources.append((source, after_key))

    def add(self, source: DataFrame, after_key: Any = None) -> MergerBuilder:
        self.push(source, after_key)
        return self

    def extend(self, sources: Iterable[DataFrame]) -> MergerBuilder:
        for s in sources:
            self.push(s)
        return self

    def build(self) -> Merger:
        return Merger(self.merge, list(self.sources))


@dataclass(frozen=True)
class Merger:
    merge: Merge
    sources: list[tuple[DataFrame, Any]]

    @staticmethod
    def builder(merge: Merge) -> MergerBuilder:
        return MergerBuilder(merge)

    def rows(self) -> DataFrame:
        """(source_index, key, val, ord) of all sources, one at least; each source's filter reaches its scan."""
        tagged = []
        for k, (source, after) in enumerate(self.sources):
            some = source if after is None else source.where(F.col("key") > F.lit(after))
            seq = F.col("seq").cast("long") if "seq" in source.columns else F.lit(0).cast("long")
            tagged.append(some.select(F.lit(k).alias("source_index"), "key", "val", F.struct(F.lit(k).alias("source_index"), seq.alias("seq")).alias("ord")))
        return reduce(DataFrame.unionByName, tagged)

    def merged(self) -> DataFrame:
        """(key, val), in no order; binary and empty without sources."""
        return fold(self.rows(), self.merge, "ord") if self.sources else empty()

    def into_stream_merger_iter(self) -> DataFrame:
        """(key, val) by key, with one shuffle for an ordered merge, as a sorter does it."""
        if self.sources and self.merge.ordered and not isinstance(self.merge, MergeUdf):
            return fold(self.rows().repartitionByRange("key"), self.merge, "ord").orderBy("key")
        return self.merged().orderBy("key")

    def write_into_stream_writer(self, writer: Writer) -> Reader:
        """Compaction: all sources as one sorted dataset."""
        return writer.write(self.merged(), sorted_input=False)
