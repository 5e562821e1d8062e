"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import ann, chat, flac, mixing, quality, sampling, secrets, simhash, tokens, urls
from stratakv.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 4-word shingles, links at 4 or fewer differing bits."""
    found = simhash.near_dups(table(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: trees learnt from at most quality.SAMPLE labelled rows that are not held out."""
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), "predicted")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a FLAC stream, and what the stored bytes decode to."""
    return flac.features(flac.store(table(spark, sf_dir, "documents")))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the template's own control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_chats(turns.unionByName(own)))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: all documents mixed to 150% of their words."""
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as sampled pieces, and what they decode to."""
    return sampling.digests(table(spark, sf_dir, "documents"))


@query
def op10_ann_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 10 nearest found of the rows whose vec_id is divisible by 100, among all rows."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, domain, action, since: every page against a dated list.

    The tables hold neither lists nor fetch times, so both are made by rule: a page was fetched on 2020-01-01 plus
    page_id * 7919 mod 1461 days. Of every host, less a leading www., m. or blog., for which first letter's code plus
    length is odd a history is listed: blocked from a day on, lifted 200 days later if its length is 1 mod 3, allowed after
    500 days if it is divisible by 3.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(1461)).cast("int"))
    names = pages.select(F.regexp_replace(urls.host(F.col("url")), r"^(www|m|blog)\.", "").alias("domain")).where("domain is not null").distinct()
    names = names.where((F.ascii("domain") + F.length("domain")) % 2 == 1)
    first = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.ascii("domain") * 37 + F.length("domain") * 101, F.lit(1461)).cast("int"))
    begun = names.withColumn("first", first)
    entries = begun.select("domain", F.lit("block").alias("action"), F.col("first").alias("since"))
    entries = entries.union(begun.where(F.length("domain") % 3 == 1).select("domain", F.lit(urls.LIFT), F.date_add("first", 200)))
    entries = entries.union(begun.where(F.length("domain") % 3 == 0).select("domain", F.lit("allow"), F.date_add("first", 500)))
    found = urls.decide(pages.withColumn("fetched", fetched), entries)
    return found.select(F.col("capture.page_id").alias("page_id"), "host", "domain", "action", "since")


ORACLE_SQL["op6_url_filters"] = r"""
WITH captures AS (
  SELECT page_id, nullif(lower(rtrim(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.')), '') AS host,
         CAST(date '2020-01-01' + CAST((page_id * 7919) % 1461 AS INTEGER) AS DATE) AS fetched
  FROM pages),
names AS (
  SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS domain FROM captures WHERE host IS NOT NULL),
begun AS (
  SELECT domain, CAST(date '2020-01-01' + CAST((ascii(domain) * 37 + length(domain) * 101) % 1461 AS INTEGER) AS DATE) AS first
  FROM names WHERE (ascii(domain) + length(domain)) % 2 = 1),
entries AS (
  SELECT domain, 'block' AS action, first AS since FROM begun
  UNION ALL SELECT domain, 'lift', CAST(first + 200 AS DATE) FROM begun WHERE length(domain) % 3 = 1
  UNION ALL SELECT domain, 'allow', CAST(first + 500 AS DATE) FROM begun WHERE length(domain) % 3 = 0),
intervals AS (
  SELECT domain, action, since, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM entries),
spread AS (
  SELECT page_id, host, fetched, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) AS name
  FROM captures),
matched AS (
  SELECT s.page_id, i.domain, i.action, i.since, row_number() OVER (PARTITION BY s.page_id ORDER BY length(i.domain) DESC) AS nth
  FROM spread s JOIN intervals i ON s.name = i.domain AND i.action <> 'lift' AND s.fetched >= i.since AND (i.until IS NULL OR s.fetched < i.until))
SELECT c.page_id, c.host, m.domain, m.action, m.since
FROM captures c LEFT JOIN matched m ON c.page_id = m.page_id AND m.nth = 1
"""


#: What escaping adds: a character for each backslash and each control string, and for each newline of a role.
ORACLE_SQL["op9_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, before IS NULL OR before <> role AS opens,
         length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|\[NEXT\]')) AS text_size,
         length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|\[NEXT\]|\n')) AS role_size
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_size + CASE WHEN opens THEN 8 + role_size ELSE 6 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
