"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged to a
block by array functions, and blocks are concatenated:

    <s>role\\ntext[NEXT]text</s>

Control strings inside roles and texts are escaped reversibly, so that turns can be read back from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that mean something to the template or to tokenizers; no escaped text holds one.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]"]
OPEN, CLOSE, NEXT = "<s>", "</s>", "[NEXT]"
LOSS_ROLE = "assistant"
#: Turns or spans that are handled one after the other; conversations are handled by runs of so many, as lists that grow cost the square of their length.
RUN = 256


def escape(text: Column) -> Column:
    """A backslash becomes \\0, the first character of a control string \\1 (for <) or \\2 (for [)."""
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    text = F.regexp_replace(text, r"<(?=/?s>)", r"\\1")
    return F.regexp_replace(text, r"\[(?=/?INST\]|NEXT\])", r"\\2")


def unescape(text: Column) -> Column:
    for mark, plain in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\3"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss_spans array<struct<start,stop>>): a row for each conversation.

    Turns are ordered by turn (null first), then role, then text. Null texts and roles count as empty; repeated rows are
    turns of their own; rows of a null conv_id form one conversation. Spans count code points of `formatted` and
    cover each assistant text, nothing between. Other columns are ignored. No rows give no conversations. A
    conversation is one row, so it has to fit in one, at most 2 GB.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    escaped = F.transform("t", lambda x: F.struct(escape_role(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    sorted_turns = sorted_turns.select("conv_id", escaped.alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    headed = sorted_turns.withColumn("starts", starts)

    def block(first: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("t"))
        return F.struct(F.get("t", first)["role"].alias("role"), F.transform(F.slice("t", first + 1, stop - first), lambda x: x["text"]).alias("texts"))

    merged = headed.select("conv_id", F.transform("starts", block).alias("blocks"))
    written = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit("\n"), F.array_join(b["texts"], NEXT), F.lit(CLOSE)))
    return merged.select("conv_id", F.array_join(written, "").alias("formatted"), loss_spans(F.col("blocks")).alias("loss_spans"))


def by_run(values: Column) -> Column:
    """An array as an array of arrays of RUN items or fewer. It is bound to a variable, for an expression inside a function of items is computed for each of them."""

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(v, k, F.lit(RUN)))

    return F.flatten(F.transform(F.array(values), cut))


def running(values: Column) -> Column:
    """The sum of the items before each item of an array of int, and that of all at the end."""
    first = F.array(F.lit(0))
    return F.aggregate(values, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def loss_spans(blocks: Column) -> Column:
    """Where the texts of assistant blocks stand, by running lengths: inside runs of texts first, then over the runs."""

    def lengths(b: Column) -> Column:
        """What stands before each text of a block (and behind the block before, on its account), and each text."""
        return F.transform(b["texts"], lambda x, k: F.struct(F.when(k == 0, len(OPEN) + 1 + F.char_length(b["role"])).otherwise(len(NEXT)).alias("head"), F.char_length(x).alias("size"), F.when(k == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("tail"), (b["role"] == LOSS_ROLE).alias("mine")))

    def placed(run: Column) -> Column:
        at = running(F.transform(run, lambda x: x["head"] + x["size"] + x["tail"]))
        spans = F.zip_with(run, F.slice(at, F.lit(1), F.size(run)), lambda x, a: F.struct((a + x["head"]).alias("start"), (a + x["head"] + x["size"]).alias("stop"), x["mine"].alias("mine")))
        return F.struct(F.element_at(at, -1).alias("all"), F.filter(spans, lambda s: s["mine"]).alias("spans"))

    runs = F.transform(by_run(F.flatten(F.transform(blocks, lengths))), placed)
    begun = running(F.transform(runs, lambda r: r["all"]))
    return F.flatten(F.zip_with(runs, F.slice(begun, F.lit(1), F.size(runs)), lambda r, a: F.transform(r["spans"], lambda s: F.struct((a + s["start"]).alias("start"), (a + s["stop"]).alias("stop")))))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>>: every original turn, from the formatted text alone."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.char_length(role) + 2)
        role = unescape(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, r"\[NEXT\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order. A run of spans is cut out as a whole first, for a substring is found by counting from the front."""

    def of_run(run: Column) -> Column:
        first, last = F.element_at(run, 1)["start"], F.element_at(run, -1)["stop"]
        held = F.array(F.substr(formatted, first + 1, last - first))
        return F.flatten(F.transform(held, lambda text: F.transform(run, lambda s: unescape(F.substr(text, s["start"] - first + 1, s["stop"] - s["start"])))))

    return F.array_join(F.flatten(F.transform(by_run(spans), of_run)), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    read = chats.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
