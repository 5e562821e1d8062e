import random

import pytest
import sentencepiece

from stratakv.llm import pieces, tokens
from stratakv.llm.queries import QUERIES

ODD = ["", " ", "   ", "\n", "\n\n a", "a", " a", "a ", "  two  spaces  ", "▁", "▁▁a▁ b", "<s> </s> <unk> <0x0A>", "\t tab\r\nline", "日本語 テスト", " x y", "é é", "🙂🙂 x", "AAAA" * 50, "x" * 5000, "\x00\x01 z", " \n \n ", "​", "don't  stop—now…", "ſt ﬁ ①"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_whole_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expect = {r.doc_id: (len(r.text.encode()), len(library.encode(r.text))) for r in rows}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    assert got == expect


def test_odd_texts(library):
    model = pieces.model_bytes()
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(ODD + ["a", " ", "\n", "the", "ing "]) for _ in range(rng.randrange(12))) for _ in range(400)]
    for text in texts:
        assert tokens.count_tokens(model, text) == len(library.encode(text)), repr(text)


def test_memory_is_bounded(library):
    """Long words are not remembered, and short ones up to a bound."""
    model = pieces.model_bytes()
    rng, known = random.Random(4), tokens.memory(model)
    before = len(known)
    for _ in range(20):
        text = "".join(rng.choice("abcdefghij") for _ in range(20_000))
        assert tokens.count_tokens(model, text) == len(library.encode(text))
    assert len(known) == before
    text = "one  two three\n" * 60_000
    assert len(text) > tokens.LONG and tokens.count_tokens(model, text) == len(library.encode(text))


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50 * tokens.WORD_BYTES)
    monkeypatch.setattr(tokens, "AT_ONCE", 40)
    model = pieces.model_bytes()
    for k in range(60):
        text = f"word{k}x {k * 7919} qq{k} zz{k * 31} abc{k}def"
        assert tokens.count_tokens(model, text) == len(library.encode(text))
        assert len(tokens.memory(model)) - len(tokens.single_tokens(model)) < 70


def test_shortcut_is_proved(library):
    model = pieces.model_bytes()
    known = tokens.single_tokens(model)
    assert len(known) > 10_000
    for word in list(known)[::97]:
        alone = library.encode(word[1:]) if word.startswith(" ") and len(word) > 1 else library.encode("\n" + word)[2:]
        assert len(alone) == 1


def test_edge_rows(spark, library):
    rows = [(1, None, 7), (1, "", 7), (None, "a b", 7), (2, "a b", 7), (2, "a b", 7), (3, "long words " * 30_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t, _ in rows), key=str)
    assert tokens.token_counts(df.where("false")).count() == 0
