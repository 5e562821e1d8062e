import hashlib
import random
import time

import duckdb
from pyspark.sql import functions as F

from stratakv.llm import chat
from stratakv.llm.queries import ORACLE_SQL, QUERIES


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    """conv -> digests but for formatted_chars, from the rows themselves."""
    convs = {}
    for c, n, role, text in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert got(QUERIES["op9_chat_format"](spark, sf)) == plain([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_control_strings_and_edges(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROL, "\\", "\\0", "\\1", "\\2", "\\3", "<", "[", "s>", "NEXT]", "\n", "", " ", "é🙂", "$1", "text", "/s>"]
    rows = []
    for c in range(60):
        for n in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([n, None]), rng.choice(["user", "assistant", "assistant", "system", None, "a\nb", "<s>", ""]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])))
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (77, 5, "assistant", "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "conv_id long, turn long, role string, text string, t int, formatted string")
    chats = chat.format_chats(df)
    assert got(chat.digests(chats)) == plain(rows)
    for r in chats.collect():
        assert r.formatted.count("<s>") == r.formatted.count("</s>") and "[INST]" not in r.formatted
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


def test_oracle(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = duck.execute(ORACLE_SQL["op9_chat_format"])
    names = [c[0] for c in found.description]
    df = QUERIES["op9_chat_format"](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))


def test_long_conversation(spark):
    """100,000 turns, and a block of 2,000: in time that does not grow with their square."""
    n = 100_000
    role = F.when((F.col("id") < 2000) | (F.col("id") % 2 == 0), "assistant").otherwise("user")
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("turn \\ <s> "), "id").alias("text"))
    began = time.monotonic()
    assert got(chat.digests(chat.format_chats(df))) == plain([(1, k, "assistant" if k < 2000 or k % 2 == 0 else "user", f"turn \\ <s> {k}") for k in range(n)])
    assert time.monotonic() - began < 120


def test_adjacent_turns_merge(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).first()
    assert r.formatted == "<s>user\na[NEXT]b</s><s>assistant\nc[NEXT]d</s>"
    assert [r.formatted[s.start : s.stop] for s in r.loss_spans] == ["c", "d"]


def test_plan_is_native(spark, sf, capsys):
    QUERIES["op9_chat_format"](spark, sf).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))
