"""Token counts with a whole-token shortcut.

Once per model it is proved, by encoding every vocabulary string by itself, which of them encode alone as one
token. A text is cut into words that no merge can cross; those that are such strings count 1 directly, and
only the rest are merged, each distinct one once for as long as the worker's memory of counts holds it.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import by_batch
from stratakv.llm.pieces import NORMAL, SPACE, model_bytes, processor, vocabulary, word_pattern

#: Bytes of merged words that a worker remembers, about; beyond that it starts anew. Words of over LONGEST characters are not remembered.
REMEMBERED, LONGEST = 48 << 20, 64
#: What a word is taken to cost.
WORD_BYTES = 200
#: Characters of a text that is cut into words at once, and bytes of words that are merged at once.
LONG, AT_ONCE = 1 << 19, 1 << 20


@lru_cache(maxsize=2)
def single_tokens(model: bytes) -> dict[str, int]:
    """Words, with spaces as spaces, proved to encode as exactly one token."""
    sp = processor(model)
    strings = [x.replace(SPACE, " ") for x, kind in vocabulary(model) if kind == NORMAL]
    pattern = word_pattern(model)
    strings = [x for x in strings if pattern.fullmatch(x)]
    return {x: 1 for x, n in zip(strings, merged(model, strings), strict=True) if n == 1}


@lru_cache(maxsize=2)
def dummy_cost(model: bytes) -> int:
    """Tokens of a mark that stands alone before whatever follows."""
    return len(processor(model).encode("\n"))


def merged(model: bytes, words: list[str]) -> list[int]:
    """Token counts of words by the library. It puts a space before a text, so a word's own first space is left out; a word without one is measured behind a newline, which merges with nothing."""
    sp = processor(model)
    out = sp.encode([w[1:] if w.startswith(" ") and len(w) > 1 else "\n" + w for w in words], num_threads=1)
    lone = dummy_cost(model)
    return [len(x) - (0 if w.startswith(" ") and len(w) > 1 else lone) for w, x in zip(words, out, strict=True)]


@lru_cache(maxsize=2)
def memory(model: bytes) -> dict[str, int]:
    return dict(single_tokens(model))


def count_tokens(model: bytes, text: str) -> int:
    """Tokens the library gives the whole text, without added ones; 0 for an empty text."""
    if not text:
        return 0
    known, pattern = memory(model), word_pattern(model)
    if WORD_BYTES * (len(known) - len(single_tokens(model))) > REMEMBERED:
        known.clear()
        known.update(single_tokens(model))
    said = " " + text.replace(SPACE, " ")
    words = Counter(pattern.findall(said) if len(said) <= LONG else (m.group() for m in pattern.finditer(said)))
    total, rest, size = 0, [], 0
    for w, n in words.items():
        if (count := known.get(w)) is not None:
            total += count * n
            continue
        rest.append(w)
        size += len(w)
        if size >= AT_ONCE:
            total += counted(model, rest, words)
            rest, size = [], 0
    return total + counted(model, rest, words)


def counted(model: bytes, rest: list[str], words: Counter[str]) -> int:
    """Tokens of words that are not yet known, as often as they stand; the short ones are remembered."""
    known, total = memory(model), 0
    for w, count in zip(rest, merged(model, rest), strict=True):
        total += count * words[w]
        if len(w) <= LONGEST:
            known[w] = count
    return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for each row of docs.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows, null ids and other columns have no effect on
    a row's counts; an empty table gives no rows.
    """
    model = model_bytes(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [count_tokens(model, x or "") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, type=pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = chosen.mapInArrow(by_batch(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
