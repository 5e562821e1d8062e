"""URL filters as a temporal join with dated lists.

A list is a history: from a date on, a domain has an action (block, allow, ...) or none. Each entry becomes a
validity interval that ends where the domain's next entry begins. A capture is looked up by its host and each of
the host's parent domains against the entry active at its fetch time; the longest domain with an active entry decides.

The as-of join is an equi-join on the domain with the interval as a condition. At most one entry of a domain is active at a time, so
it makes no more rows than there are domains of captures; a hot host is one key, whose captures Spark splits over
tasks (adaptive skew join), as the list's side of it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An entry with this action ends the one before it and sets nothing.
LIFT = "lift"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; null where there is none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    found = F.lower(F.rtrim(found, F.lit(".")))
    return F.when(found != "", found)


def domains(name: Column) -> Column:
    """The host and its parent domains of two labels or more, or the host alone if it has one."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until): entries (domain, action, since) as intervals [since, until); until is null for the last.

    Entries with a null domain, action or date are ignored. Of entries of one domain and date the last action by
    code point holds. Repeated entries change nothing.
    """
    good = entries.select(F.lower("domain").alias("domain"), "action", "since").where("domain is not null and action is not null and since is not null")
    one = good.groupBy("domain", "since").agg(F.max("action").alias("action"))
    later = Window.partitionBy("domain").orderBy("since")
    return one.withColumn("until", F.lead("since").over(later)).where(F.col("action") != LIFT)


def decide(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """(capture struct, host, domain, action, since): a row for each capture, the last three null where no entry is active.

    capture holds the row as it was, so that no name can clash. Null or odd URLs have no host, and null fetch
    times no active entry. Parents of a single label are not looked up: an entry such as "xyz" decides only the host "xyz". Repeated rows and null ids are rows of their own; an empty list decides nothing.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("capture"), host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").alias("at"))
    spread = rows.select("row", "capture", "host", "at", F.posexplode_outer(domains(F.col("host"))).alias("nth", "domain"))
    kept = F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("capture"))  # once for each row
    spread = spread.select("row", kept.alias("capture"), "host", "at", "domain")
    active = (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    joined = spread.join(intervals(entries).withColumnRenamed("domain", "listed"), (F.col("domain") == F.col("listed")) & active, "left")
    best = F.max(F.when(F.col("listed").isNotNull(), F.struct(F.length("listed").alias("n"), "listed", "action", "since")))
    out = joined.groupBy("row").agg(F.first("capture", ignorenulls=True).alias("capture"), F.first("host", ignorenulls=True).alias("host"), best.alias("best"))
    return out.select("capture", "host", F.col("best.listed").alias("domain"), F.col("best.action").alias("action"), F.col("best.since").alias("since"))
