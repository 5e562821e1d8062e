import random
import re

from stratakv.llm import simhash


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= 0.8:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def corpus(rng, n=60):
    words = ["w%d" % k for k in range(400)]
    rows = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        rows.append(base)
        for _ in range(rng.randrange(4)):
            other = list(base)
            for _ in range(rng.randrange(1, 4)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append(other)
    passage = [rng.choice(words) for _ in range(60)]
    rows += [[rng.choice(words) for _ in range(90)] + passage for _ in range(30)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_against_brute_force(spark):
    rows = corpus(random.Random(1))
    rows += [(5000, None), (5001, " "), (5002, "a b"), (5003, "A  b"), (5004, "x " * 50_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert got == brute(rows)
    assert simhash.near_copies(df.where("false")).count() == 0


def test_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash.dealt, "__defaults__", (8,))
    monkeypatch.setattr(simhash, "PART", 8)
    rows = corpus(random.Random(2), 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == brute(rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z y x"), (2, "q r s")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2)], key=str)


def words_of(rng, n):
    return ["v%d" % rng.randrange(100_000) for _ in range(n)]


def test_repeats_count_once(spark):
    """Equal or alike sets whose shingles repeat 20 times in one and once in the other."""
    rng, rows = random.Random(5), []
    for k in range(40):
        body, line = words_of(rng, 105), words_of(rng, 8)
        rows += [(2 * k, " ".join(body + line + line[:4])), (2 * k + 1, " ".join(body + line * 20))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and all(got[2 * k + 1] == 2 * k for k in range(40))


def test_long_documents(spark):
    """Documents of some 6,000 shingles a little above and below the similarity asked for."""
    rng, rows = random.Random(6), []
    for k in range(24):
        base = words_of(rng, 6000)
        n = 6000 - int(6000 * (2 * 0.8 / 1.8)) + (-12 if k % 2 else 12)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(words_of(rng, n) + base[n:]))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and sum(got[2 * k + 1] == 2 * k for k in range(24)) == 12


def test_contained_documents(spark):
    """Copies with a quarter of new text appended: exactly 0.8 alike, and many share none of their first keys."""
    rng, rows = random.Random(7), []
    for k in range(1000):
        base = words_of(rng, 44)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + words_of(rng, 10)))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d // 2 * 2 for d, _ in rows)
