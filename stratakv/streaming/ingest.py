"""A sorter fed by a stream: each micro-batch becomes a sorted run, and runs are merged when there are many.

`path/run-A-B` is the run of batches A to B. A batch that is run again after a failure finds its run and changes
nothing, and a run that covers others replaces them, so a reader sees each batch exactly once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratakv.functions.merge import Merge
from stratakv.operators.merger import Merger
from stratakv.operators.sorter import Sorter
from stratakv.sources.store import Reader, WriterBuilder

RUN = re.compile(r"run-(\d+)-(\d+)")


@dataclass(frozen=True)
class StreamSorter:
    """merge: associative; path: below a store that all executors share; max_runs: runs at which all are merged to one."""

    spark: SparkSession
    merge: Merge
    path: str
    max_runs: int = 25
    options: WriterBuilder = WriterBuilder()

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of the finished runs that none other covers, in order."""
        fs, root = self._store()
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = RUN.fullmatch(status.getPath().getName())
            if name and fs.exists(self._path(f"{self.path}/{name[0]}/_meta/_SUCCESS")):
                found.append((int(name[1]), int(name[2])))
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _store(self):
        root = self._path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _name(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]:09d}-{run[1]:09d}"

    def write_batch(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: batch has key, val, and seq if the merge is ordered."""
        if any(first <= number <= last for first, last in self.runs()):
            return
        self._fresh((number, number))
        Sorter.new(self.merge).insert(batch).write_into_stream_writer(self.options.build(self._name((number, number))))
        if len(self.runs()) >= max(2, self.max_runs):
            self.compact()

    def _fresh(self, run: tuple[int, int]) -> None:
        """Removes what a failed attempt left."""
        self._store()[0].delete(self._path(self._name(run)), True)

    def compact(self) -> None:
        """All runs as one; the old ones go when the new one is whole."""
        old = self.runs()
        if len(old) < 2:
            return
        new = (old[0][0], old[-1][1])
        self._fresh(new)
        self._merger(old).write_into_stream_writer(self.options.build(self._name(new)))
        for run in old:
            self._fresh(run)

    def _merger(self, runs: list[tuple[int, int]]) -> Merger:
        builder = Merger.builder(self.merge)
        builder.extend(Reader.open(self.spark, self._name(r)).entries for r in runs)
        return builder.build()

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        """(key, val) by key, of all batches so far."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "key binary, val binary")
        return self._merger(runs).merged().orderBy(F.col("key"))
