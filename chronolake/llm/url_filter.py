"""URL filter with redirect equivalence.

Pages that redirect to each other or name the same canonical page are aliases: connected components over
those edges carry a block decision to every alias that has no rule of its own.  A rule of its own, an
allow rule included, always wins over what reaches a page through its aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
#: A link with canonical among its rel tokens, a refresh's target, which may hold a ;, and a page's base.
CANONICAL_LINK = r"""(?is)<link\b[^>]*(?<![\w-])rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))[^>]*>"""
REFRESH_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
BASE = r"(?is)<base\b[^>]*(?<![\w-])href\s*=\s*[\"']?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _fitting(host: Column, path: Column, rules: list[tuple[str, str, str]], value) -> Column:
    """The value of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    return _fitting(host, path, rules, lambda r: r[1] + r[2])


def verdict_of(host: Column, path: Column, rules=RULES) -> Column:
    return _fitting(host, path, rules, lambda r: r[0])


def _once(value: Column, use) -> Column:
    """use(value), with value in the plan only once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), none, lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.array_append(a, s)))
    out = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"^/(?s:.*/)?\.\.?(?:/|\z)"), out).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """The URL that a reference on the page of url names."""
    root = F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "(?s)^.*/", 0)
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path_of(url), to))
        .when((to == "") | to.startswith("#"), url)
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )


def node_of(url: Column) -> Column:
    """A URL as a node: without scheme, fragment and dot segments; null if it has no host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), without_dots(path_of(url)), query))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(source, target) nodes for every canonical link and meta refresh of the columns url and html.

    Targets are resolved against the page's base, or else its URL.
    """
    url, html = F.col("url"), F.col("html")
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL_LINK), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH_TARGET, 1)),
    )
    plain = lambda to: F.replace(to, F.lit("&amp;"), F.lit("&"))
    found = pages.where(html.rlike("(?i)canonical|refresh") & (host_of(url) != "")).select("url", F.regexp_extract("html", BASE, 1).alias("base"), F.explode(tags).alias("to"))
    base = _once(resolved(url, plain(F.col("base"))), lambda b: F.when(host_of(b) != "", b).otherwise(url))
    target = _once(base, lambda b: _once(resolved(b, plain(F.col("to"))), node_of))
    return found.where("to <> ''").select(node_of(url).alias("source"), target.alias("target")).where("source is not null and target is not null and source <> target")


def url_verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, id_column: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    Host and path are empty for a null URL and one without ://; no rule fits those.  The verdict is that
    of the longest fitting rule; else block if an alias is blocked by a rule, else allow.  edges adds
    (source, target) URLs, such as observed redirects, to the links found in html.  Repeated rows get
    the same row each; an empty table gives an empty table.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.union(edges.select(node_of(F.col("source")), node_of(F.col("target"))))
    links = written(links.distinct(), "aliases")
    pages = pages.select(F.col(id_column).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    pages = pages.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "own": verdict_of(F.col("host"), F.col("path"), rules)})
    if links.isEmpty():
        return pages.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    labels = connected_components(links, "source", "target")
    as_url = F.concat(F.lit("http://"), F.col("node"))
    bad = labels.where(verdict_of(host_of(as_url), path_of(as_url), rules) == "block").select("component").distinct()
    blocked = labels.join(bad, "component", "left_semi").select("node", F.lit("block").alias("reached"))
    return pages.join(blocked, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "reached", F.lit("allow")).alias("verdict"))
