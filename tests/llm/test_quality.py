import zlib

import numpy as np

from stratakv.llm import quality
from stratakv.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_gbt"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 80
    assert np.mean([a == b for a, b in judged]) > 0.93


def test_trees_traversal_is_the_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x, y, trees=20, depth=4)
    p = trees.score(x)
    assert np.mean((p > 0.5) == y) > 0.95
    for row in range(0, 500, 50):
        total = trees.start
        for t in range(20):
            node = 0
            while node < 15:
                node = 2 * node + 1 + int(x[row, trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.leaf[t, node - 15]
        assert abs(1 / (1 + np.exp(-total)) - p[row]) < 1e-12


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a b", 3), (3, "a b", 3), (3, "a b", 3), (4, "Long text. " * 20_000, 3)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.quality_score <= 1 for r in got)
    same = [r.quality_score for r in got if r.text == "a b"]
    assert len(set(same)) == 1
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r.quality_score for r in none} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert len(quality.statistics(b"")) == len(quality.NAMES)


def plain_fit(x, y, trees, depth, rate, bins, l2, least):
    """Margins of boosting by trying every cut of every column at every node."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(y), np.log(mean / (1 - mean)))
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins)[1:-1]))) for c in x.T]

    def grow(rows, left, g, h, out):
        best, pick = 1e-6, None
        for f in range(x.shape[1]) if left else ():
            for cut in cuts[f]:
                low = [r for r in rows if x[r, f] <= cut]
                high = [r for r in rows if x[r, f] > cut]
                if h[low].sum() < least or h[high].sum() < least:
                    continue
                gain = sum(s * g[part].sum() ** 2 / (h[part].sum() + l2) for part, s in ((low, 1), (high, 1), (rows, -1)))
                if gain > best + 1e-12:
                    best, pick = gain, (low, high)
        if pick:
            grow(pick[0], left - 1, g, h, out)
            grow(pick[1], left - 1, g, h, out)
        else:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(list(range(len(y))), depth, p - y, p * (1 - p), step)
        margin = margin + step
    return margin


def test_fit_is_the_plain_search():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3))
    x[:, 2] = np.round(x[:, 2])  # repeated values
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.5 * rng.normal(size=120)) > 0).astype(float)
    got = quality.fit(x, y, trees=4, depth=2, rate=0.3, bins=9, l2=1.0, least=3.0).score(x)
    expect = 1 / (1 + np.exp(-plain_fit(x, y, 4, 2, 0.3, 9, 1.0, 3.0)))
    assert np.allclose(got, expect, atol=1e-9)
