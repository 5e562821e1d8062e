"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import cut, dropped, lean

#: Edges that are left to one task at the end, at most.
LAST = 1 << 16


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items is joined to by the pairs."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def finished(edges: DataFrame) -> DataFrame:
    """(node, root) of LAST edges or fewer, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.empty((0, 2), dtype=np.int64), *(np.stack([c.to_numpy() for c in b.columns], axis=1) for b in batches)]
        node, place = np.unique(np.concatenate(parts), return_inverse=True)
        place = place.reshape(-1, 2)
        root = joined(len(node), place[:, 0], place[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(lean(run), "node long, root long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) long -> (node, root), root being the smallest node reachable; one row for each node of an edge.

    Each round gives the nodes new pseudorandom priorities, maps every node to the first of its closed
    neighbourhood, replaces the edges' ends by those, and drops loops and repeats. So the nodes left shrink by a
    constant factor in expectation, chains included; once LAST edges or fewer are left, one task ends it. Minima are
    pre-aggregated before the shuffle: a hub costs no task more than another. Maps and edges are cut at the shared
    checkpoint folder; a lost executor costs one round at most. An empty edge list gives an empty result; loops and repeated edges change nothing; edges
    with a null end are dropped.
    """
    edges = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    whole: DataFrame | None = None
    for k in range(rounds):
        few = edges.limit(LAST + 1).count() <= LAST
        if few and whole is None:
            out = cut(finished(edges))
            dropped(edges)
            return out
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).union(edges.select("v", "u"))
        first = F.least(F.min(F.struct(F.xxhash64("near", F.lit(k)).alias("p"), F.col("near").alias("n"))), F.struct(F.xxhash64("node", F.lit(k)).alias("p"), F.col("node").alias("n")))
        step = cut(finished(edges) if few else ends.groupBy("node").agg(first.alias("m")).select("node", F.col("m.n").alias("root")))
        if not few:
            onto = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
            moved = edges.join(onto, "u").select("ru", "v")
            moved = moved.join(onto.toDF("v", "rv"), "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            moved = cut(moved.where("u <> v").distinct())
            dropped(edges)
            edges = moved
        before, whole = whole, step
        if before is not None:
            again = step.toDF("root", "higher")
            whole = cut(before.join(again, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
            dropped(before, step)
        if few:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = whole.groupBy("root").agg(F.min("node").alias("first"))
    out = cut(whole.join(least, "root").select("node", F.least("first", "root").alias("root")))
    dropped(edges, whole)
    return out
