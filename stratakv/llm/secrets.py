"""Secret scans with multipart credential linking, in DataFrame functions only.

Each kind of match is located in one pass: `regexp_extract_all` gives the matches, `split` by the same pattern gives
what stands between, and running lengths of both give the offsets. Matches are exploded (their texts stay
behind), shuffled once by row, and placed by a window. The interval join is a band join of the sorted spans
with themselves: the furthest stop before a span and the nearest start after it tell what stands in its scope, so no pairs are made.
Weak candidates (identifiers, opaque strings, endpoints) are reported only where the complementary parts of
a credential stand in scope; strong matches are always reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.common import cut

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a longest run, so the same matches as the shorter pattern with the short ones dropped
IDENT = r"""(?i)(?:access_?key|client|account|tenant|user)_?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
OPAQUE = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"

#: Code points between the end of a part of one credential and the start of the next.
SCOPE = 256
#: Code points of the runs that a text is cut into for redaction; tasks over which rows of one text are dealt.
RUN, SALTS = 4096, 16
#: Bytes of digests and spans that are broadcast, at most.
MOST_BROADCAST = 8 << 20
#: Kinds in the order in which spans with one start are listed; the first three are strong.
KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]
STRONG = 3
#: The parts that each kind can be.
IDENTIFIERS, SECRETS = (1, 3), (0, 2, 4)  # the rest are endpoints


def kinds(text: Column) -> list[tuple[str, Column, Callable[[Column], Column]]]:
    """(pattern, cheap test that every text with a match passes, test of a match) by kind."""
    low = F.lower(text)

    def has(*words: str) -> Column:
        out = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            out |= F.contains(low, F.lit(w))
        return out

    return [
        (ASSIGN, has("passw", "secret", "token", "api"), lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        (ACCESS, F.contains(text, F.lit("AKIA")), lambda m: F.char_length(m) >= 20),
        (HEX, F.lit(True), lambda m: F.char_length(m) > 0),
        (IDENT, has("key", "client", "account", "tenant", "user"), lambda m: F.char_length(m) > 0),
        (OPAQUE, F.lit(True), lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[G-Zg-z+/]"))),
        (ENDPOINT, F.contains(low, F.lit("://")), lambda m: F.char_length(m) > 0),
    ]


def matches(text: Column) -> Column:
    """array<struct<kind int, nth int, gap int, size int, fits boolean>>: all matches, each with the length of what stands before it."""
    empty = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,fits:boolean>>")

    def located(kind: int, pattern: str, maybe: Column, fits: Callable[[Column], Column]) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
        all_of = F.transform(pairs, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("nth"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("size"), fits(x["hit"]).alias("fits")))
        return F.when(maybe & F.rlike(text, F.lit(pattern)), all_of).otherwise(empty)

    return F.concat(*[located(kind, *rest) for kind, rest in enumerate(kinds(text))])


def scan(docs: DataFrame, scope: int = SCOPE, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc struct, spans array<struct<start,ord,stop,kind,before>>): a row for each row of docs.

    doc holds the row as it was, or its columns in `keep`, so that no name can clash. Spans are those reported, by start and then kind, with code points and
    an exclusive stop; `before` is the furthest stop of the spans before. Null texts count as empty. Repeated rows
    and null ids are rows of their own. An empty table gives no rows.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spread = docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), matches(text).alias("m"))
    spread = spread.select("row", "doc", F.posexplode_outer("m").alias("pos", "m"))
    kept = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("doc"))  # once for each row
    spread = spread.select("row", kept.alias("doc"), "m.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    stop = F.sum(F.col("gap") + F.col("size")).over(order).cast("int")
    placed = spread.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def about(kinds: tuple[int, ...]) -> Column:
        part = F.col("fits") & F.col("kind").isin(*kinds)
        ended = F.max(F.when(part, F.col("stop"))).over(upto) >= F.col("start") - scope
        begun = F.min(F.when(part, F.col("start"))).over(onward) <= F.col("stop") + scope
        return F.coalesce(ended, F.lit(False)) | F.coalesce(begun, F.lit(False))

    joined = placed.withColumn("ident", about(IDENTIFIERS)).withColumn("secret", about(SECRETS))
    kind = F.col("kind")
    complete = F.when(kind < STRONG, True).when(kind.isin(*IDENTIFIERS), F.col("secret")).when(kind.isin(*SECRETS), F.col("ident")).otherwise(F.col("ident") & F.col("secret"))
    told = joined.withColumn("told", F.col("fits") & complete)
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.coalesce(F.max(F.when(F.col("told"), F.col("stop"))).over(before), F.lit(0))
    span = F.struct("start", F.col("kind").alias("ord"), "stop", F.element_at(F.array(*map(F.lit, KINDS)), kind + 1).alias("kind"), furthest.alias("before"))
    told = told.select("row", "doc", F.when(F.col("told"), span).alias("span"))
    return told.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.sort_array(F.collect_list("span")).alias("spans")).select("doc", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of scan()'s rows."""

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["ord"] < STRONG)
    return found.select(F.col(f"doc.`{id_col}`").alias("doc_id"), *map(count, range(STRONG)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def cleaned(text: Column, spans: Column, mark: str) -> Column:
    """text with every span replaced by the mark, adjoining or overlapping ones by one. What stands between is taken out of runs of RUN code points, so that time does not grow with text times spans."""

    def between(runs: Column, s: Column) -> Column:
        first, last = F.floor(s["before"] / RUN).cast("int"), F.floor(s["start"] / RUN).cast("int")
        about = F.array_join(F.slice(runs, first + 1, last - first + 1), "")
        return F.substr(about, s["before"] - first * RUN + 1, s["start"] - s["before"])

    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))
    # the runs are a variable of an outer lambda: an expression inside would be computed for each span
    pieces = F.transform(F.array(runs), lambda r: F.transform(spans, lambda s: F.when(s["start"] >= s["before"], F.concat(between(r, s), F.lit(mark))).otherwise(F.lit(""))))[0]
    last = F.array_max(F.transform(spans, lambda s: s["stop"]))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substr(text, last + 1)))


def redact(found: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The documents of scan()'s rows, with every reported span replaced by the mark. Texts without spans stay as they were, null too."""
    clean = cleaned(F.col(f"doc.`{text_col}`"), F.col("spans"), mark)
    columns = [c for c in found.schema["doc"].dataType.names]
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in columns])


def redacted(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE, text_col: str = "text") -> DataFrame:
    """redact(scan(docs)), row by row and column by column, without a shuffle of the texts while what was found is small.

    Only the texts' SHA-256 goes with their spans. What was found is written and measured: up to MOST_BROADCAST bytes it is broadcast,
    beyond that both sides are shuffled, and rows of one text are dealt to SALTS tasks.
    """
    text = F.col(f"`{text_col}`")
    of = F.unhex(F.sha2(text.cast("binary"), 256))
    found = scan(docs.select(of.alias("of"), text.alias("text")), scope, keep=["of"]).where(F.size("spans") > 0)
    spans = F.transform("spans", lambda s: F.struct(s["start"], s["stop"], s["before"])).alias("spans")
    found = cut(found.select(F.col("doc.of").alias("of"), spans).groupBy("of").agg(F.first("spans").alias("spans")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), of.alias("of"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    size = found.agg(F.sum(64 + 12 * F.size("spans").cast("long")).alias("n")).first().n or 0
    if size <= MOST_BROADCAST:
        return redact(rows.join(F.broadcast(found), "of", "left"), mark, text_col)
    each = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return redact(rows.join(each.hint("merge"), ["of", "salt"], "left"), mark, text_col)
