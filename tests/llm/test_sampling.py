import random
from collections import Counter

from stratakv.llm import pieces, sampling
from stratakv.llm.queries import QUERIES

ODD = ["", " ", "   ", "\n", "\n\n a", "a", " a", "a ", "  two  spaces  ", "▁", "▁▁a▁ b", "<s> </s>", "\t tab\r\nline", "日本語 テスト", "\x00\x01", "é é", "🙂🙂 x", "AAAA" * 50, "x" * 3000, "don't—now…"]


def segmentations(word, lattice):
    """Every segmentation with its weight, by plain recursion."""
    if not word:
        return {(): 1.0}
    out = {}
    for n in range(1, min(len(word), lattice.longest) + 1):
        head = word[:n]
        found = lattice.pieces.get(head) or ((lattice.spell(head), lattice.rare) if n == 1 else None)
        if found:
            for rest, w in segmentations(word[n:], lattice).items():
                out[(found[0], *rest)] = w * found[1]
    return out


def test_samples_follow_the_lattice():
    own = sampling.Lattice(pieces.model_bytes())
    for word in ("the", "▁b日", "instance"):
        exact = segmentations(" " + word, own)
        total = sum(exact.values())
        n = 4000
        drawn = Counter(tuple(map(int, x)) for x in own.sample([word] * n, list(range(n)), 3))
        expect = {}
        for s, w in exact.items():
            ids = tuple(i for p in s for i in ([p] if p < own.size else own.spellings[p - own.size]))
            expect[ids] = expect.get(ids, 0) + w / total
        assert set(drawn) <= set(expect)
        assert sum(abs(drawn[s] / n - p) for s, p in expect.items()) / 2 < 0.06


def test_round_trip():
    model = pieces.model_bytes()
    own = sampling.Lattice(model)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([*ODD, "a", " ", "the", "ing "]) for _ in range(rng.randrange(9))) for _ in range(200)]
    found = own.sample(texts, list(range(len(texts))), 7)
    assert [sampling.decoded(model, x.tolist()) for x in found] == texts
    again = sampling.Lattice(model).sample(texts[::-1], list(range(len(texts)))[::-1], 7)[::-1]  # whatever the batch and the order
    assert all((a == b).all() for a, b in zip(found, again, strict=True))
    assert any((a.shape != b.shape) or (a != b).any() for a, b in zip(found, own.sample(texts, list(range(len(texts))), 8), strict=True))


def test_pieces_are_of_the_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = sampling.Lattice(pieces.model_bytes())
    for text, ids in zip(ODD, own.sample(ODD, [0] * len(ODD), 1), strict=True):
        if "▁" not in text:
            assert sp.decode(ids.tolist()) == text or text.startswith(" ")


def test_whole_table(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = QUERIES["op7_sentencepiece"](spark, sf).collect()
    assert len(rows) == n and all(r.lossless for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op7_sentencepiece"](spark, sf).collect()))


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (None, "a b", 1), (3, "same text", 1), (3, "same text", 1), (4, "wörter 日 " * 20_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    out = sampling.decode(sampling.encode(df)).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.decoded)) for r in out) == sorted((str(d), str(t), str(t)) for d, t, _ in rows)
    same = [r.pieces for r in out if r.doc_id == 3]
    assert same[0] == same[1]
    assert sampling.encode(df.where("false")).count() == 0
    assert all(r.lossless for r in sampling.digests(df).collect())


def unbroken(n):
    """Long words: with many places that no piece crosses, and with none."""
    rng = random.Random(n)
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    return [base64, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)), "🙂" * n, "a" * n, " " * n, "-=" * (n // 2), base64 + "a" * n + "語" + " " * n]


def test_long_words_take_few_steps(monkeypatch):
    model = pieces.model_bytes()
    own, steps, drawn = sampling.Lattice(model), [], sampling.Lattice.drawn
    monkeypatch.setattr(sampling.Lattice, "drawn", lambda self, *a: steps.append(1) or drawn(self, *a))
    texts = unbroken(20_000)
    found = own.sample(texts, list(range(len(texts))), 5)
    assert [sampling.decoded(model, x) for x in found] == texts
    assert len(steps) <= 256  # as many as the pieces of the longest word before: 20,000
    other = sampling.Lattice(model)
    assert all((other.sample([t], [k], 5)[0] == found[k]).all() for k, t in reversed(list(enumerate(texts))))  # whatever else is in the batch


def test_parts_end_where_no_piece_crosses(monkeypatch):
    own = sampling.Lattice(pieces.model_bytes())
    monkeypatch.setattr(sampling, "AT_ONCE", 50)
    rng = random.Random(2)
    for word in [*unbroken(300), "".join(rng.choice(["the", "ing", "日", "Q", "zx", "aaaa", "é", "9"]) for _ in range(200))]:
        crossed = {c for a in range(len(word)) for n in range(2, own.longest + 1) if word[a : a + n] in own.pieces and a + n <= len(word) for c in range(a + 1, a + n)}
        ends = [0, *(c for c in range(1, len(word)) if c not in crossed), len(word)]
        assert list(own.parts(word)) == [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def test_words_alone_are_drawn_as_in_lockstep(monkeypatch):
    words = ["a" * 40, " " * 70, "-" * 200, "x" * 150]
    texts = [w for w in words for _ in range(50)]
    one = sampling.Lattice(pieces.model_bytes())
    side = one.sample(texts, list(range(len(texts))), 1)
    monkeypatch.setattr(sampling, "LONG_WORD", 8)
    own = sampling.Lattice(pieces.model_bytes())
    alone = own.sample(texts, list(range(len(texts))), 1)
    assert own.alone and not one.alone and all(list(own.parts(" " + w)) == [" " + w] for w in words)
    assert all((a == b).all() for a, b in zip(side, alone, strict=True))


def test_long_words_follow_the_lattice(monkeypatch):
    monkeypatch.setattr(sampling, "LONG_WORD", 2)  # all words are cut, and what is left goes alone
    own = sampling.Lattice(pieces.model_bytes())
    for word in ("the", "instance", "日the語", "aaaa"):
        exact = segmentations(" " + word, own)
        expect = {tuple(i for p in s for i in ([p] if p < own.size else own.spellings[p - own.size])): w for s, w in exact.items()}
        total, n = sum(expect.values()), 4000
        drawn = Counter(tuple(map(int, x)) for x in own.sample([word] * n, list(range(n)), 3))
        assert set(drawn) <= set(expect)
        assert sum(abs(drawn[s] / n - w / total) for s, w in expect.items()) / 2 < 0.06


def test_short_texts_are_taken_together(monkeypatch):
    model, hashed = pieces.model_bytes(), []
    own, hash_of = sampling.Lattice(model), sampling.hash_of
    texts = [*ODD, *ODD[::-1], ""] * 20
    monkeypatch.setattr(sampling, "hash_of", lambda *parts: hashed.append(1) or hash_of(*parts))
    keys = list(range(-9, len(texts) - 9))
    found = own.sample(texts, keys, 1)
    assert len(hashed) < 9  # one for each text before
    assert all((own.sample([t], [k], 1)[0] == x).all() for t, k, x in zip(texts[:50], keys, found, strict=False))
    ends = [sum(map(len, found[: k + 1])) for k in range(len(found))]
    assert [x.decode() for x in sampling.decoded_bytes(model, sampling.np.concatenate(found), sampling.np.array(ends))] == texts
