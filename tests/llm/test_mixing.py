import random
import re
from collections import Counter

import numpy as np

from stratakv.llm import mixing
from stratakv.llm.queries import QUERIES


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """By small steps: everyone open gets its share of what is left until nothing is."""
    weight = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    left = 1.5 * sum(sizes)
    for _ in range(10_000):
        free = [k for k in range(len(sizes)) if out[k] < 2 * sizes[k] - 1e-9]
        if not free or left < 1e-9:
            break
        give = left
        for k in free:
            more = min(give * weight[k] / sum(weight[j] for j in free), 2 * sizes[k] - out[k])
            out[k] += more
            left -= more
    return out


def test_targets():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([0, 1, 10, 500, rng.randrange(100_000)]) for _ in range(rng.randrange(1, 12))]
        assert np.allclose(mixing.targets(sizes), plain_targets(sizes), rtol=1e-6, atol=1e-4), sizes


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))
        assert n < 17 or mixing.permuted(np.arange(n), n, 99).tolist() != mixing.permuted(np.arange(n), n, 98).tolist()


def check(rows, docs):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    assert len(rows) == len(docs)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), size(t)) for d, t, _ in docs)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - wanted[s]) <= 1, (s, taken[s], wanted[s])


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = mixing.mix_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    check(rows, docs)
    got = sorted(map(tuple, QUERIES["op3_mix_sources"](spark, sf).collect()))
    assert got == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows)


def odd(rng, n):
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 300, 255, 256, 257])), rng.choice(["a", "b", "é", None, ""])) for i in range(n)]


def test_edge_rows(spark):
    docs = [*odd(random.Random(2), 150), (None, None, "a"), (None, "x y", None), (3, "same row here", "b"), (3, "same row here", "b"), (700, "long " * 60_000, "b"), (701, " \t\n", "c")]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, source string, size int, key string")
    check(mixing.mix_documents(df).collect(), docs)
    assert mixing.mix_documents(df.where("false")).count() == 0
    assert mixing.mixed_texts(df.where("false")).count() == 0
    nothing = mixing.mix_documents(df.where("text is null")).collect()
    assert [(r.size, r.taken) for r in nothing] == [(0, 0)]


def test_slots_are_whole(spark):
    """Block by block: no block is read more than twice, all slots of the draw are there, and the shards' draws are the multinomial ones but for what was settled."""
    df = spark.createDataFrame(odd(random.Random(3), 300), "doc_id long, text string, source string")
    mix = mixing.prepare(df)
    rows = mixing.slots(mix).collect()
    assert len(rows) == int(mix.plan.slots.sum())
    words = Counter()
    for r in rows:
        words[r.source_ix] += r.take
    assert [words[k] for k in range(len(mix.plan.size))] == mix.plan.quota.tolist()
    assert max(Counter((r.source_ix, r.block) for r in rows).values()) <= 2
    assert max(Counter((r.source_ix, r.block, r.epoch) for r in rows).values()) == 1


def test_shards(monkeypatch, spark):
    monkeypatch.setattr(mixing, "SLOTS", 16)
    df = spark.createDataFrame(odd(random.Random(4), 300), "doc_id long, text string, source string")
    mix = mixing.prepare(df)
    rows = mixing.slots(mix).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == mix.plan.shards > 3 and set(list(counts.values())) <= {16, len(rows) % 16}
    assert len(rows) == int(mix.plan.slots.sum())
    assert max(Counter((r.source_ix, r.block) for r in rows).values()) <= 2


def test_texts(spark):
    docs = odd(random.Random(5), 60)
    docs = [(d, (t or "").replace("w", f"w{d}").replace(" ", "  \n", 1), s) for d, t, s in docs]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(df).collect()}
    out = mixing.mixed_texts(df).collect()
    assert {r.doc_id: size(r.text) for r in out} == {d: n for d, n in taken.items() if n}
    text = {d: t for d, t, _ in docs}
    for r in out:
        assert r.n_chars == len(r.text)
        if size(r.text) == size(text[r.doc_id]):
            assert r.text == text[r.doc_id] or taken[r.doc_id] == size(text[r.doc_id])


def test_taken_word_by_word(spark, monkeypatch):
    """Each slot's words counted one by one, for the documents that own them."""
    monkeypatch.setattr(mixing, "SLOTS", 16)
    docs = [*odd(random.Random(6), 200), (None, "x y", None), (3, "same row here", "b"), (3, "same row here", "b"), (700, "long " * 3000, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = mixing.prepare(df)
    keys = [r.key for r in sorted(mix.sources.collect(), key=lambda r: r.source_ix)]
    rows = sorted(mix.rows.collect(), key=lambda r: (r.bucket, r.h, r.doc_id is not None, r.doc_id or 0))
    owners = {k: [n for n, r in enumerate(rows) if r.key == k for _ in range(r["size"])] for k in keys}
    taken = Counter()
    for slot in mixing.slots(mix).collect():
        at = slot.block * mixing.BLOCK
        some = owners[keys[slot.source_ix]][at : at + slot["take"]]
        assert len(some) == slot["take"]
        taken.update(some)
    expect = Counter((r.doc_id, r["size"], taken[n]) for n, r in enumerate(rows))
    assert Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix_documents(df).collect()) == expect
