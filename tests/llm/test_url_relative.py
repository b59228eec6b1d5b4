"""Links relative to a page, as urllib resolves them, and their part in components."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sievework.llm")

from sievework.llm import url_equivalence  # noqa: E402


def test_relative_links(spark):
    bases = ["http://a.net/x/y/page.html?q=1", "http://a.net/x/", "http://a.net/"]
    links = ["next.html", "./n", "../n", "../../n?a=../b", "../../../n", ".", "..", "./", "a/./b/../c", "?p=2", "/out?u=http://x/", "/a/../b", "//b.net/z", "http://c.net/1"]
    df = spark.createDataFrame([(b, k) for b in bases for k in links], "base string, link string")
    for r in df.withColumn("u", url_equivalence.absolute(F.col("link"), F.col("base"))).collect():
        assert r.u == urljoin(r.base, r.link), r
    other = spark.createDataFrame([("mailto:a@b.c",), ("#top",), ("javascript:x()",)], "link string")
    assert all(r.u is None for r in other.select(url_equivalence.absolute(F.col("link"), F.lit(bases[0])).alias("u")).collect())


def test_relative_alias_is_blocked(spark):
    pages = [(1, "http://shop.com/de/1", ""), (2, "http://alias.net/a/1", '<link rel="canonical" href="http://shop.com/de/1">'), (3, "http://alias.net/a/b/2", '<meta http-equiv="refresh" content="0; url=../1">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_equivalence.judge(df).collect()} == {1: "block", 2: "block", 3: "block"}


def test_oracle_on_pages_with_links(spark, tmp_path):
    """The registered SQL against Spark where links decide: relative and root links, queries that hold URLs, cycles, a hub, a long
    chain, rules on either side, other schemes, pages without a host and repeated pages."""
    import duckdb

    from sievework.llm.queries import ORACLE_SQL

    link = lambda u: f'<link rel="canonical" href="{u}">'
    go = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [("http://shop.com/de/1", ""), ("http://alias.net/a/1", link("http://shop.com/de/1")), ("http://alias.net/a/b/2", go("../1")), ("http://alias.net/a/c", link("./b/../1"))]
    pages += [("http://q.net/x", link("/out?u=http://shop.com/de/1")), ("http://q.net/out?u=http://shop.com/de/1", ""), ("http://q.net/d/e", link("?p=2")), ("http://q.net/d/e?p=2", go("//shop.com/de/1"))]
    pages += [(f"http://ring.net/{k}", link(f"http://ring.net/{(k + 1) % 5}")) for k in range(5)] + [("http://ring.net/3", go("http://example.org/es/x"))]
    pages += [(f"http://hub.net/{k}", link("http://hub.net/all")) for k in range(12)] + [("http://hub.net/all", link("http://shop.com/fr/x"))]
    pages += [(f"http://chain.net/d/{k}", link(f"{k + 1}")) for k in range(40)] + [("http://chain.net/d/40", go("http://de.shop.com/de/"))]
    pages += [("http://www.example.org/en/1", link("http://free.net/")), ("http://free.net/", ""), ("http://mail.net/", link("mailto:a@b.c")), ("no host", link("http://shop.com/de/1")), (None, None), ("http://free.net/", ""), ("http://up.net/a", link("../../b/.")), ("http://up.net/b/", link("/x/../../c/..")), ("http://up.net/", link("HTTP://SHOP.com/de/9"))]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = c.execute(ORACLE_SQL["op9_url_equivalence"])
    names = [d[0] for d in found.description]
    theirs = sorted(tuple(r[names.index(n)] for n in ("page_id", "host", "path", "rule", "verdict")) for r in found.fetchall())
    mine = sorted(tuple(r) for r in url_equivalence.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert mine == theirs
    blocked = {r[0] for r in mine if r[4] == "block"}
    assert {1, 2, 3, 6, 7, *range(8, 14), *range(27, 68)} <= blocked and not {4, 5, *range(14, 27)} & blocked
