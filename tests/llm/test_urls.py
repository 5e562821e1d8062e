import random
from datetime import date

import duckdb

from stratakv.llm import urls
from stratakv.llm.queries import ORACLE_SQL, QUERIES


def plain_host(url):
    import re

    m = re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    return m[1].rstrip(".").lower() or None if m else None


def plain(url, at, entries):
    """The entry that decides, by trying all of them."""
    h = plain_host(url)
    best = (None, None, None)
    if h is None or at is None:
        return (h, *best)
    labels = h.split(".")
    for k in range(max(1, len(labels) - 1)):
        name = ".".join(labels[k:])
        dated = sorted((s, a) for d, a, s in entries if None not in (d, a, s) and d.lower() == name and s <= at)
        if dated and dated[-1][1] != urls.LIFT:
            return (h, name, dated[-1][1], dated[-1][0])
    return (h, *best)


def test_decide(spark):
    rng = random.Random(1)
    names = ["example.com", "a.example.com", "b.a.example.com", "EXAMPLE.org", "localhost", "x.y.z.net", "z.net"]
    entries = [(rng.choice(names), rng.choice(["block", "allow", "lift"]), date(2020, rng.randrange(1, 13), rng.choice([1, 15]))) for _ in range(50)]
    entries += [(None, "block", date(2020, 1, 1)), ("z.net", None, date(2020, 1, 1)), ("z.net", "block", None), entries[0]]
    captures = []
    for i in range(300):
        name = rng.choice([*names, "other.com", "c.b.a.example.com"])
        url = rng.choice([f"http://{name}/p?q#f", f"https://u:p@{name}:8080", f"{name}/x", f"FTP://{name.upper()}./", None, "", "mailto:x@y.z"])
        captures.append((rng.choice([i, None, 1]), url, rng.choice([None, date(2020, rng.randrange(1, 13), rng.randrange(1, 28))]), "h", 3))
    df = spark.createDataFrame(captures, "page_id long, url string, fetched date, host string, row int")
    listed = spark.createDataFrame(entries, "domain string, action string, since date")
    got = sorted(map(str, ((tuple(r.capture), r.host, r.domain, r.action, r.since) for r in urls.decide(df, listed).collect())))
    assert got == sorted(map(str, ((c, *plain(c[1], c[2], entries)) for c in captures)))
    assert urls.decide(df.where("false"), listed).count() == 0
    assert {r.action for r in urls.decide(df, listed.where("false")).collect()} == {None}


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    expect = con.execute(ORACLE_SQL["op6_url_filters"])
    names = [c[0] for c in expect.description]
    rows = QUERIES["op6_url_filters"](spark, sf)
    assert sorted(rows.columns) == sorted(names)
    got = sorted(map(str, map(tuple, rows.select(*names).collect())))
    assert got == sorted(map(str, expect.fetchall()))
    assert any("block" in x for x in got)
