"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

An index is a random rotation and the centres of lists, fitted on a bounded sample (SAMPLE); every vector is
put in the list of its nearest centre. A query scans the lists whose centres are nearest. In a list the rotated
vectors are read in blocks of columns: after each block a hypothesis test compares the distance extrapolated from
the columns so far with the k-th best distance known, and candidates that are almost surely worse are dropped.
What remains gets its exact distance, in double precision, from the vectors as given.

How many lists are probed is chosen at fit time, as the fewest with a recall of AIM among the sample, whose
neighbours are farther apart than those of all rows. Equal vectors are folded first: of those that share a
vector only the k + 1 smallest ids can be in any answer. Long lists are cut into parts, and so are
their queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.common import cut, lean

#: Vectors that the index is fitted on, at most, and their bytes: those with the smallest hash of their id.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: Recall at which the number of probed lists is set, within the sample.
AIM = 0.985
#: Lists, at most; rows of a list's part; queries of a part.
MAX_LISTS, PART, QUERIES = 2048, 4096, 2048
#: Columns of a block, and the test's tolerance: a candidate goes if its extrapolated distance is over the best by 1 + SLACK / sqrt(columns).
COLUMNS, SLACK = 16, 2.1


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def near(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distances to the centres."""
        return (rotated**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * rotated @ self.centres.T

    def own(self, rotated: np.ndarray) -> np.ndarray:
        """The list of each vector, by slices of bounded bytes."""
        step = max(1, (1 << 21) // len(self.centres))
        return np.concatenate([np.empty(0, dtype=np.int64), *(self.near(rotated[at : at + step]).argmin(axis=1) for at in range(0, len(rotated), step))])


def fit(sample: np.ndarray, rows: int, k: int = 10, seed: int = 1) -> Index:
    """sample: (n, d) double, n > 0; rows: vectors that will be indexed."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    x = sample @ rotation
    lists = max(1, min(MAX_LISTS, round(rows**0.5), n // 8))
    centres = x[rng.choice(n, lists, replace=False)]
    for _ in range(8):
        own = Index(rotation, centres, 1).own(x)
        count = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    index = Index(rotation, centres, lists)
    own = index.own(x)
    asked = np.arange(0, n, max(1, n // 300))
    far = (x[asked] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * x[asked] @ x.T
    far[np.arange(len(asked)), asked] = np.inf
    found = np.argsort(far, axis=1)[:, : min(k, n - 1)]
    place = np.argsort(np.argsort(index.near(x[asked]), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[found], axis=1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))))]) if len(needed) else lists
    return Index(rotation, centres, min(lists, probes))


def scan(query: np.ndarray, raw_query: np.ndarray, blocks: list[np.ndarray], raw: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest in a part: blocks are the rotated vectors' columns, ids break ties."""
    alive = np.flatnonzero(ids != own)
    if not len(alive):
        return alive, np.empty(0)
    d = query.shape[0]
    partial = np.zeros(len(alive))
    limit = np.inf
    seen = 0
    for block in blocks:
        width = block.shape[1]
        step = block[alive] - query[seen : seen + width]
        partial += np.einsum("ij,ij->i", step, step)
        seen += width
        if seen >= d or len(alive) <= k:
            break
        first = np.argpartition(partial, k - 1)[:k]
        exact = ((raw[alive[first]] - raw_query) ** 2).sum(axis=1).max()
        limit = min(limit, float(exact))
        keep = np.flatnonzero(partial * (d / seen) <= limit * (1 + SLACK / seen**0.5) ** 2 + 1e-12)
        keep = np.union1d(keep, first)
        alive, partial = alive[keep], partial[keep]
    exact = np.sqrt(((raw[alive] - raw_query) ** 2).sum(axis=1))
    best = np.lexsort((ids[alive], exact))[:k]
    return alive[best], exact[best]


# ---------------------------------------------------------------- distributed


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, and a vector with no null or non-finite and some non-zero component."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance and then vec_id.

    Queries are the rows whose id is divisible by `every`, candidates all other rows. Rows with a null id or vector, a null or non-finite component, or zeros only take no
    part; nor do those whose dimension is not the one that most rows have. Rows that repeat an id with the same vector count once; a row never
    finds one of its own id. With k candidates or fewer all are found. No usable rows give no rows.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors, id_col, vector_col)
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], shape)
    d, rows = most["d"], most["count"]
    good = good.where(F.size("v") == d)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))).toArrow().column("v").combine_chunks()
    index = fit(matrix(sample, d), rows, k, seed)
    copies = Window.partitionBy("v").orderBy("vec_id")
    folded = good.distinct().withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).drop("nth")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = index.own(matrix(part.column(1), d) @ index.rotation)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *part.columns], names=["list", "vec_id", "v"])

    listed = cut(folded.mapInArrow(lean(assign), "list int, vec_id long, v array<double>"))
    counts = np.zeros(len(index.centres), dtype=np.int64)
    for r in listed.groupBy("list").count().collect():  # MAX_LISTS rows at most
        counts[r["list"]] = r["count"]
    parts = np.maximum(1, -(-counts // PART))
    asking = good.where(F.col("vec_id") % every == 0).distinct()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                order = np.argsort(index.near(matrix(part.column(1), d) @ index.rotation), axis=1)
                reach = np.cumsum(counts[order], axis=1)
                enough = (np.arange(order.shape[1]) < index.probes) | (np.roll(reach, 1, axis=1) * (np.arange(order.shape[1]) > 0) < 4 * (k + 1))
                row, col = np.nonzero(enough & (counts[order] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(order[row, col].astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns)], names=["list", "vec_id", "v"])

    probed = asking.mapInArrow(lean(probe), "list int, vec_id long, v array<double>")
    asked = np.zeros(len(counts), dtype=np.int64)
    for r in probed.groupBy("list").count().collect():  # MAX_LISTS rows at most
        asked[r["list"]] = r["count"]
    turns = np.maximum(1, -(-asked // QUERIES))
    few = F.broadcast(spark.createDataFrame([(i, int(p), int(t)) for i, (p, t) in enumerate(zip(parts, turns, strict=True))], "list int, parts int, turns int"))

    def dealt(df: DataFrame, own: str, whole: str, mine: str, other: str) -> DataFrame:
        df = df.join(few, "list").withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col(own)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(whole) - 1))).select("list", "part", "turn", "vec_id", "v")

    left = dealt(listed, "parts", "turns", "part", "turn")
    right = dealt(probed, "turns", "parts", "turn", "part")

    def search(_key: tuple, have: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if have.num_rows and ask.num_rows:
            raw = matrix(have.column("v").combine_chunks(), d)
            rotated = raw @ index.rotation
            blocks = [np.ascontiguousarray(rotated[:, c : c + COLUMNS]) for c in range(0, d, COLUMNS)]
            ids = have.column("vec_id").to_numpy()
            raw_queries = matrix(ask.column("v").combine_chunks(), d)
            for query, raw_query, own in zip(raw_queries @ index.rotation, raw_queries, ask.column("vec_id").to_pylist(), strict=True):
                place, score = scan(query, raw_query, blocks, raw, ids, own, k)
                for a, b in zip(out, (np.full(len(place), own), ids[place], score), strict=True):
                    a.append(b)
        columns = [pa.array(np.concatenate(a) if a else [], type=t) for a, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    key = ["list", "part", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
