"""URL filter with redirect equivalence, in DataFrame functions only.

Rules decide a URL by host and path, the longest rule first. Pages that no rule decides may be other names of blocked ones:
canonical links and meta refreshes in the pages, and redirects given as a table, link URLs; the connected components of these links are found
by `common.connected_components`, and a component with a blocked URL blocks its URLs without a rule. A URL with a rule
of its own keeps that rule's verdict, so an explicit allow is never overridden, nor does it free others.

URLs are compared without scheme, fragment, and A-Z in the host. Only URLs that a link names take part in the components,
so pages without links cost a scan.

Cases: a null url, or one without "://", has an empty host and path and is judged alone; repeated pages share their URL's
verdict; links to themselves and links of pages without a URL are ignored; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, columns_only, connected_components

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The canonical link's or refresh's target, with the attributes in either order.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule (host and path) and verdict; of equals the one listed first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        out = F.when(fits(host, path, rule), F.struct(F.lit(rule[1] + rule[2]).alias("rule"), F.lit(rule[0]).alias("verdict"))).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """What stands for a URL in links: host, path and query; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def folded(path: Column) -> Column:
    """A path from the root without its segments . and .. (RFC 3986, 5.2.4)."""
    empty = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    names = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(names, empty, step), "/"))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a whole URL: links with a scheme, without one (//host), from the host's root (/path), and from the
    page's own place (name, ./name, ../name, ?query). Null for other schemes (mailto:) and for places within the page."""
    link = F.regexp_replace(link, "&amp;", "&")
    root = F.concat(F.lit("http://"), host_of(base))
    name, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    at = F.regexp_extract(path_of(base), r"(?s)^.*/", 0)
    near = F.concat(root, folded(F.concat(F.when(at == "", "/").otherwise(at), name)), rest)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, F.when(name.rlike(r"/\.\.?(/|$)"), folded(name)).otherwise(name), rest))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .when(~link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)") & (link != ""), near)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of the pages' canonical links and refreshes."""
    html = F.coalesce("html", F.lit(""))
    targets = F.array(*(F.regexp_extract(html, p, 1) for p in (CANONICAL, REFRESH)))
    wanted = pages.where(html.rlike("(?i)canonical|refresh")).select("url", F.explode(targets).alias("link")).where("link <> ''")
    return wanted.select(F.col("url").alias("from_url"), absolute(F.col("link"), F.col("url")).alias("to_url"))


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict. redirects: (from_url, to_url), e.g. of a crawl's log."""
    given = columns_only(pages, "page_id", "url", "html")
    links = page_links(given)
    if redirects is not None:
        links = links.unionByName(columns_only(redirects, "from_url", "to_url"))
    keys = links.select(url_key(F.col("from_url")).alias("a_key"), url_key(F.col("to_url")).alias("b_key"), F.col("from_url").alias("a_url"), F.col("to_url").alias("b_url"))
    keys = checkpointed(keys.where("a_key is not null and b_key is not null and a_key <> b_key"))
    node = lambda c: F.xxhash64(c)
    named = given.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    named = named.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if keys.isEmpty():
        verdict = F.coalesce("own.verdict", F.lit("allow"))
        return named.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
    found = connected_components(keys.select(node("a_key").alias("a"), node("b_key").alias("b")))
    ends = keys.select(F.explode(F.array(F.struct(F.col("a_key").alias("key"), F.col("a_url").alias("url")), F.struct(F.col("b_key").alias("key"), F.col("b_url").alias("url")))).alias("e")).select("e.*")
    urls = ends.groupBy("key").agg(F.min("url").alias("url")).withColumn("node", node("key")).join(found, "node")
    judged = urls.withColumn("own", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)).select("key", "component", (F.col("own.verdict") == "block").alias("bad"))
    judged = checkpointed(judged)
    blocked = judged.groupBy("component").agg(F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad")).where("bad").select("component")
    aliases = judged.join(blocked, "component", "left_semi").select("key").withColumn("alias", F.lit(True))
    # Pages without a rule look their URL up; the others and those without a URL don't move.
    open_ = F.col("own").isNull() & F.col("key").isNotNull()
    looked = named.where(open_).join(aliases, "key", "left").withColumn("verdict", F.when(F.col("alias"), "block").otherwise("allow"))
    fixed = named.where(~open_).withColumn("verdict", F.coalesce("own.verdict", F.lit("allow")))
    return looked.select("page_id", "host", "path", F.col("own.rule").alias("rule"), "verdict").unionByName(fixed.select("page_id", "host", "path", F.col("own.rule").alias("rule"), "verdict"))
