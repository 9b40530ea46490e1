"""URL filters with redirect equivalence, with DataFrame operations only.

Rules judge a url by host suffix and path prefix. Redirect and canonical links make pages
aliases of each other; a block decision spreads over the connected component, and a page
that a rule allows stays allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, lower_ascii, settle

#: The rules of the contract, (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_GOES = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(h: Column, p: Column, rules=RULES, most: int = 1000) -> Column:
    """The longest rule that fits, as text, else null. Rules are literals of the plan, so
    their number is bounded; of two equal rules that disagree, allow wins."""
    if len(rules) > most:
        raise ValueError(f"{len(rules)} rules; at most {most} fit in a plan")
    out = None
    for _, r in sorted(rules, key=lambda x: (-len(x[1]), x[0])):
        rh, _, rp = r.partition("/")
        test = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit("/" + rp))
        out = F.when(test, F.lit(r)) if out is None else out.when(test, F.lit(r))
    return F.lit(None).cast("string") if out is None else out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    """``allow`` or ``block`` of a rule's text, else null."""
    said = {r: v for v, r in sorted(rules, reverse=True)}  # allow overwrites block
    out = F.lit(None).cast("string")
    for r, v in said.items():
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """What two urls share if they name one page: host, path and query, without scheme and
    fragment. Null for a url without host."""
    h = host(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(h != "", F.concat(h, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def _resolved(base: Column, link: Column) -> Column:
    """A link of a page as an absolute url."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    top = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(top, link))
        .otherwise(F.concat(top, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): keys of a page and of the canonical or refresh target its markup names.

    Pages without such a word are left out before any pattern runs. A page that names no
    target, or itself, gives no edge.
    """
    url, html = F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
    tags = pages.select(url, html).where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), 0)).alias("tag"))
    link = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), F.regexp_extract("tag", _HREF, 1)).when(
        F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.regexp_extract("tag", _GOES, 1)
    )
    found = settle(tags, link=F.replace(link, F.lit("&amp;"), F.lit("&"))).where("link != ''")
    keys = settle(found, a=url_key(F.col("url")), b=url_key(_resolved(F.col("url"), F.col("link"))))
    return keys.select("a", "b").dropna().where("a != b").distinct()


def judge(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names
    in the input are replaced.

    ``redirects`` (columns ``source`` and ``target``, urls) adds links that were seen
    while fetching. A page has its own rule's verdict; without a rule it is blocked if a
    url in its component is blocked, else allowed. So an explicit allow takes precedence
    on its own page, and doesn't stop a block from reaching other aliases.

    A null url, or one without ``://``, has empty host and path, fits no rule, has no
    aliases and is allowed. Null html names no target. Rows, repeated ones too, are judged
    one by one; an empty table gives an empty table.

    Links and components stay distributed; only blocked keys that have aliases are
    joined with the pages.
    """
    names = ("host", "path", "rule", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in names])
    edges = alias_edges(pages, url_col=url_col, html_col=html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")).dropna())
    comps = connected_components(edges, "a", "b", "alias")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = settle(settle(comps, h=host(as_url), p=path(as_url)), rule=fitting_rule(F.col("h"), F.col("p"), rules))
    bad = ruled.where(rule_verdict(F.col("rule"), rules) == "block").select("component").distinct()
    key, hit = fresh("_key", pages), fresh("_hit", pages)
    spread = comps.join(bad, "component").select(F.col("node").alias(key), F.lit(True).alias(hit))
    url = F.col(f"`{url_col}`")
    out = settle(pages, **{key: url_key(url), "host": host(url), "path": path(url)}).join(spread, key, "left")
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), F.when(F.col(hit), F.lit("block")), F.lit("allow"))
    return settle(settle(out, rule=fitting_rule(F.col("host"), F.col("path"), rules)), verdict=verdict).drop(key, hit)
