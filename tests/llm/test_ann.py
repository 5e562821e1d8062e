import math

import numpy as np
import pyarrow as pa
import pytest

from stratakv.llm import ann
from stratakv.llm.queries import QUERIES


def brute(rows, k=10, every=100):
    """[(vec_id, vector)] -> query -> [(score, vec_id)], by comparing all."""
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in ok], dtype=np.int64)
    x = np.array([v for _, v in ok], dtype=float)
    out = {}
    for i, v in ok:
        if i % every == 0:
            score = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            some = sorted({(float(s), int(j)) for s, j in zip(score, ids, strict=True) if j != i})
            out[i] = some[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(rows)] for q, rows in out.items()}


def recall(got, expect):
    hits = sum(len({i for _, i in got[q]} & {i for _, i in some}) for q, some in expect.items())
    return hits / sum(map(len, expect.values()))


def check(got, expect):
    assert set(got) == set(expect)
    for q, some in got.items():
        assert len(some) == len(expect[q])
        assert some == sorted(some)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, expect = found(QUERIES["op10_ann_adaptive"](spark, sf)), brute(rows)
    check(got, expect)
    assert recall(got, expect) >= 0.95


@pytest.mark.parametrize("n", [500, 10_000, 50_000])
def test_recall_at_sizes(spark, n):
    """Vectors about centres of their own, with one very common vector among them."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(max(8, n // 200), 32))[rng.integers(0, max(8, n // 200), n)] + 0.6 * rng.normal(size=(n, 32))
    x[rng.random(n) < 0.3] = x[0]
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x))}))
    every = max(5, n // 200)
    got = found(ann.neighbours(df, every=every))
    hits = 0
    for q in range(0, n, every):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(n), far))[:10]
        hits += len({i for _, i in got[q]} & set(best.tolist()))
        assert np.allclose([s for s, _ in got[q]], far[[i for _, i in got[q]]])
    assert hits / (10 * len(range(0, n, every))) >= 0.9


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 300)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)] + [(100, rows[50][1]), (200, [1.0] * 8)]
    rows += [(500, None), (600, [0.0] * 8), (700, [float("nan")] + [1.0] * 7), (800, [None] + [1.0] * 7), (900, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (200, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, list int, score double")
    got, expect = found(ann.neighbours(df)), brute(rows)
    check(got, expect)
    assert recall(got, expect) >= 0.9
    assert got[200] == expect[200]  # sixty ties
    few = [(100, [1.0, 2.0]), (3, [2.0, 2.0]), (4, [5.0, 2.0])]
    small = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert found(ann.neighbours(small)) == {100: [(1.0, 3), (4.0, 4)]}
    assert ann.neighbours(df.where("false")).count() == 0
    assert ann.neighbours(df.where("vec_id = 600")).count() == 0


def test_parts_and_turns(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 16)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 0.01]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, expect = found(ann.neighbours(df, every=5)), brute(rows, every=5)
    check(got, expect)
    assert recall(got, expect) >= 0.9


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(2000, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    rotated = raw @ rotation
    blocks = [np.ascontiguousarray(rotated[:, c : c + 16]) for c in range(0, 64, 16)]
    hits = 0
    for q in range(50):
        place, score = ann.scan(rotated[q], raw[q], blocks, raw, np.arange(2000), q, 10)
        far = np.sqrt(((raw - raw[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(set(place) & set(np.argsort(far)[:10]))
        assert np.allclose(score, far[place])
    assert hits / 500 > 0.98
