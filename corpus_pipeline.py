"""From raw documents to token ids: five operators, each working on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import mixing, quality, sampling, secrets, simhash
from stratakv.llm.common import cut, dropped, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs have no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality")
    return quality.score(docs, trees, score).where(F.col(score) >= 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are 0.8 alike in runs of five words one row stays: that with the smallest doc_id, and of those that with the smallest text hash. Texts of a repeated id that are not alike are in groups of their own; rows without an id all stay."""
    groups = simhash.alike(docs).where("doc_id is not null")
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "of")).alias("m")).select("m.doc_id", "m.of")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # one column, so that no name clashes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), whole.alias("row"))
    kept = rows.join(first, ["doc_id", "of"], "left_semi").groupBy("doc_id", "of").agg(F.first("row").alias("row"))  # repeats of one row
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark; n_chars is counted anew."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it; documents of which it takes none go."""
    return mixing.mixed_texts(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, pieces: sampled token ids, checked to decode to the text."""
    coded = sampling.checked(docs.select("doc_id", "source", "text"), ["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A stage with a trained classifier cannot be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read as the next one's input, and goes when that one's output is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = cut(stage(spark, docs, sf_dir))
        dropped(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
