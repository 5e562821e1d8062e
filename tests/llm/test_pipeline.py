import re

import pytest

import corpus_pipeline as cp
from stratakv.llm import quality, sampling, simhash
from tests.llm.test_near_copies import brute, corpus
from tests.llm.test_secrets import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows after each stage, each stage fed with what the one before wrote."""
    place = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(place / str(k)))
        docs = spark.read.parquet(str(place / str(k)))
        assert k == 4 or docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_quality_stage(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted == 1}
    assert {r.doc_id for r in stages[1]} == kept and 0 < len(kept) < len(stages[0])
    before = {r.doc_id: r for r in stages[0]}
    assert all(before[r.doc_id] == r for r in stages[1])


def test_dedup_stage(stages):
    groups = brute([(r.doc_id, r.text) for r in stages[1]])
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(groups.values()))


def test_secret_stage(stages):
    before = {r.doc_id: r.text for r in stages[2]}
    assert sorted(before) == sorted(r.doc_id for r in stages[3])
    for r in stages[3]:
        spans = [x for x in plain(before[r.doc_id])[-1].split(",") if x]
        assert (r.text == before[r.doc_id]) == (not spans)
        assert r.n_chars == len(r.text)
        assert not [x for x in plain(r.text)[-1].split(",") if x.startswith(("access", "hex"))]


def test_mixing_stage(stages):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    before = {r.doc_id: words(r.text) for r in stages[3]}
    total = sum(map(len, before.values()))
    assert abs(sum(len(words(r.text)) for r in stages[4]) - 1.5 * total) < 40
    for r in stages[4]:
        assert len(words(r.text)) <= 2 * len(before[r.doc_id]) and set(words(r.text)) <= set(before[r.doc_id])


def test_piece_stage(stages):
    text = {r.doc_id: r.text for r in stages[4]}
    model = sampling.model_bytes()
    assert len(stages[5]) == len(text)
    for r in stages[5]:
        assert r.lossless and r.n_pieces == len(r.pieces) and sampling.decoded(model, r.pieces) == text[r.doc_id]


def test_run_is_the_stages(spark, sf, stages):
    assert sorted(map(str, cp.run(spark, sf).collect())) == sorted(map(str, stages[5]))


def test_odd_documents(spark, sf):
    rows = [(d, t, "en", s, 1) for (d, t), s in zip(corpus(__import__("random").Random(4), 8), "abcabc" * 40, strict=False)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), (7000, "same here", None, "a", 3), (7000, "same here", None, "a", 3), (7001, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, docs.where("false"), sf).count() == 0
        assert stage(spark, docs, sf).columns == COLUMNS
        stage(spark, docs, sf).count()
    kept = cp.drop_near_copies(spark, docs, sf).collect()
    assert sum(r.doc_id == 7000 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    groups = simhash.near_copies(docs).collect()
    assert {r.doc_id for r in kept} - {None} == {r.component_id for r in groups} - {None}


def test_repeated_ids_of_unlike_texts(spark, sf):
    texts = ["one two three four five six seven", "an other text that is its own thing", "and a third one with words unlike both"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[1]), (5, texts[2]), (9, texts[2])]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, sf).collect())
    assert kept == sorted([(1, texts[0]), (5, texts[1]), (5, texts[2])])
