import random

import numpy as np
import xxhash

from stratakv.llm import simhash
from stratakv.llm.components import components
from stratakv.llm.queries import QUERIES


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute(rows):
    """[(doc_id, fp)] -> smallest doc_id reachable at 4 bits, by comparing all."""
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(rows))]


def check(df, rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    expect = sorted(((d, f, c) for (d, f), c in zip(prints, brute(prints), strict=True)), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=str)
    assert got == expect


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    expect = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute(prints), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    assert got == expect


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "A b C d e"), (2, "a B c D E"), (2, "a B c D E"), (None, "a b c d e"), (None, "other words stand here"), (7, "one"), (8, "x " * 40_000), (1, "été deux trois\x1cquatre cinq")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    check(simhash.near_dups(df), rows)
    assert simhash.near_dups(df.where("false")).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(300)]
    for v in values[:150]:
        for _ in range(rng.randrange(4)):
            w = v
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                w ^= 1 << b
            values.append(w)
    values = sorted(set(values))
    reps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    for rows in (None, 1 << 22, 1 << 30):  # each choice of tables
        roots = {r.node: r.root for r in components(simhash.links(reps, 4, rows)).collect()}
        got = [roots.get(simhash.signed(v), simhash.signed(v)) for v in values]
        expect = brute([(i, v) for i, v in enumerate(values)])
        assert len(set(got)) == len(set(expect))
        assert len(set(zip(got, expect, strict=True))) == len(set(expect))


def test_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash.dealt, "__defaults__", (16,))
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 200:
        w = base
        for b in rng.sample(range(64), rng.randrange(1, 9)):
            w ^= 1 << b
        values.add(w)
    values = sorted(values)
    reps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(reps, 4)).collect()}
    got = [roots.get(simhash.signed(v), simhash.signed(v)) for v in values]
    expect = brute(list(enumerate(values)))
    assert len(set(zip(got, expect, strict=True))) == len(set(expect)) == len(set(got))


def test_near_pairs_is_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 20, 400, dtype=np.uint64)
    starts = np.array([0, 1, 130, 131, 300])
    group = np.searchsorted(starts, np.arange(400), side="right")
    for radius in (0, 3, 4, 9):
        i, j = simhash.near_pairs(values, starts, radius)
        expect = {(a, b) for a in range(400) for b in range(a + 1, 400) if group[a] == group[b] and bin(int(values[a] ^ values[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == expect


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
