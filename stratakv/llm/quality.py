"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are computed once per row in Arrow batches. The trees are trained on the driver from a bounded
sample of labelled rows (SAMPLE, a parameter) and flattened into arrays, which numpy walks for a whole batch
at once, one level of all trees at a time. Scoring is a map without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.llm.common import lean, slices, texts

#: Labelled rows that a classifier learns from, at most. They are those with the smallest hash of their id.
SAMPLE = 20_000

_ASCII = np.arange(256)


def _class(chars: bytes) -> np.ndarray:
    return np.isin(_ASCII, np.frombuffer(chars, dtype=np.uint8))


#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": (_ASCII >= 65) & (_ASCII <= 90),
    "lower": (_ASCII >= 97) & (_ASCII <= 122),
    "digit": (_ASCII >= 48) & (_ASCII <= 57),
    "blank": _class(b" \t\r\x0b\x0c"),
    "newline": _class(b"\n"),
    "stop": _class(b".?"),
    "pause": _class(b",;:"),
    "shout": _class(b"!"),
    "rule": _class(b"|_=~-"),
    "sign": _class(b"#$%&*@^+\\"),
    "bracket": _class(b"()[]{}<>"),
    "quote": _class(b"\"'`"),
    "slash": _class(b"/"),
    "control": (_ASCII < 32) & ~_class(b"\t\n\r\x0b\x0c"),
    "high": _ASCII >= 128,
}
NAMES = [*CLASSES, "log_bytes", "bytes_per_char", "entropy", "words", "word_mean", "word_longest", "distinct", "top_word", "top_five", "once", "repeat", "pair_distinct", "end_sign", "end_stop", "capital", "all_upper", "short", "lines", "line_mean", "line_distinct", "zlib", "letter_runs"]


def statistics(text: bytes) -> list[float]:
    """The numbers in NAMES for a whole text; defined for the empty text too."""
    raw = np.frombuffer(text, dtype=np.uint8)
    n = max(1, len(raw))
    hist = np.bincount(raw, minlength=256)
    out = [float(hist[mask].sum()) / n for mask in CLASSES.values()]
    p = hist[hist > 0] / n
    chars = max(1, len(raw) - int(hist[128:192].sum()))
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    common = [c for _, c in counts.most_common(5)]
    ends = Counter(x[-1] for x in words)
    firsts = Counter(x[0] for x in words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = sum(c for x, c in counts.items() if x.isupper())
    short = sum(c for x, c in counts.items() if len(x) <= 3)
    out += [
        float(np.log1p(len(raw))),
        len(raw) / chars,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        float(np.log1p(len(words))),
        (len(raw) - float(hist[CLASSES["blank"]].sum()) - float(hist[10])) / w,
        float(max(map(len, counts), default=0)),
        len(counts) / w,
        (common[0] if common else 0) / w,
        sum(common) / w,
        sum(1 for c in counts.values() if c == 1) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(zip(words, words[1:], strict=False))) / w,
        sum(c for x, c in ends.items() if CLASSES["sign"][x] or x == 33) / w,
        sum(c for x, c in ends.items() if CLASSES["stop"][x] or CLASSES["pause"][x]) / w,
        sum(c for x, c in firsts.items() if 65 <= x <= 90) / w,
        upper / w,
        short / w,
        float(np.log1p(len(lines))),
        len(raw) / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(text, 1)) / n,
        float(np.count_nonzero(raw[1:] == raw[:-1])) / n,
    ]
    return out


# ---------------------------------------------------------------- trees


@dataclass(frozen=True)
class Trees:
    """Perfect trees of one depth, node k's children being 2k+1 and 2k+2, as arrays of (trees, nodes) and (trees, leaves)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(rows), self.start)
        depth = self.leaf.shape[1].bit_length() - 1 if self.leaf.size else 0
        trees = np.arange(len(self.feature))
        for at in range(0, len(rows) if len(trees) else 0, 2048):
            some = rows[at : at + 2048]
            node = np.zeros((len(some), len(trees)), dtype=np.int64)
            line = np.arange(len(some))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (some[line, self.feature[trees, node]] > self.threshold[trees, node])
            total[at : at + 2048] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Second-order boosting of the logistic loss on binned columns. No rows or one class: a constant score."""
    nodes, leaves = (1 << depth) - 1, 1 << depth
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(mean / (1 - mean)))
    if len(rows) == 0 or labels.min() == labels.max():
        return Trees(start, np.zeros((0, nodes), dtype=np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)], axis=1).astype(np.int64)
    count = rows.shape[1]
    cuts = np.full((count, bins), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    margin = np.full(len(rows), start)
    out_feature, out_threshold, out_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(rows), dtype=np.int64)
        feature, threshold = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            gs, hs = np.empty((count, wide, bins)), np.empty((count, wide, bins))
            own = (node - first) * bins
            for f in range(count):
                key = own + binned[:, f]
                gs[f] = np.bincount(key, weights=g, minlength=wide * bins).reshape(wide, bins)
                hs[f] = np.bincount(key, weights=h, minlength=wide * bins).reshape(wide, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least) | ~np.isfinite(cuts)[:, None, :]] = 0
            flat = gain.transpose(1, 0, 2).reshape(wide, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(wide), best] > 1e-6
            f, b = best // bins, best % bins
            feature[first : first + wide] = np.where(good, f, 0)
            threshold[first : first + wide] = np.where(good, cuts[f, b], np.inf)
            cut = np.where(good, b, bins)
            here = node - first
            node = 2 * node + 1 + (binned[np.arange(len(rows)), feature[node]] > cut[here])
        own = node - nodes
        leaf = -rate * np.bincount(own, weights=g, minlength=leaves) / (np.bincount(own, weights=h, minlength=leaves) + l2)
        margin += leaf[own]
        out_feature.append(feature)
        out_threshold.append(threshold)
        out_leaf.append(leaf)
    return Trees(start, np.array(out_feature), np.array(out_threshold), np.array(out_leaf))


# ---------------------------------------------------------------- distributed


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text has remainder 1 by 3; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Trees:
    """Trees from at most `sample` labelled documents that are not held out.

    Null labels are ignored; an id with several label or document rows counts once, with the smaller label. The ids sent to
    the scan number `sample` at most, 8 bytes each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([statistics(x) for x in texts(part.column(2))], type=pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    found = chosen.select("doc_id", "y", "text").mapInArrow(lean(run), "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("r.y", "r.x").toArrow()
    y = found.column("y").to_numpy()
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T[::-1], y))  # the sum of a histogram must not hang on the order of arrival
    return fit(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, trees: Trees, name: str = "quality_score") -> DataFrame:
    """docs with a score double: 0 to 1, higher for likelier label 1. Null texts count as empty. A column of that name is replaced."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = np.array([statistics(x) for x in texts(part.column(at))], dtype=float).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(trees.score(rows))], names=[*part.schema.names, name])

    return docs.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with quality_score, predicted (1 if the score is 0.5 or more) and held_out; rows keep their number, nulls and repeats."""
    scored = score(docs, train(docs, labels, sample))
    return scored.withColumn("predicted", (F.col("quality_score") >= 0.5).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))
