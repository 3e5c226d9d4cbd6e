"""URL filters whose decisions spread to the aliases of a page: redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netlens.llm.common import components, stash

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"

#: Attributes of the tags that name another address of a page.
_CANONICAL = (r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""")
_REFRESH = (r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""")


def _part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``, with A-Z in lower case; empty for other texts."""
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def address(url: Column) -> Column:
    """The node of a url: host, path and query. Scheme and fragment do not tell pages apart. Null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), _part(url, 4)))


def resolve(base: Column, link: Column) -> Column:
    """An absolute url from a link on the page ``base``."""
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(_part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("^[?#]"), F.concat(root, path_of(base), link))
        .when(link != "", F.concat(root, folder, link))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses that a page's canonical link or its redirect by refresh says are one page."""
    found = F.array(*[F.regexp_extract(F.regexp_extract(F.col(html), tag, 0), attr, 1) for tag, attr in (_CANONICAL, _REFRESH)])
    links = pages.where(F.col(html).rlike(_CANONICAL[0]) | F.col(html).rlike(_REFRESH[0])).select(F.col(url).alias("u"), F.explode(found).alias("link"))
    return links.select(address(F.col("u")).alias("a"), address(resolve(F.col("u"), F.col("link"))).alias("b")).where("a <> b").distinct()


def best_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule, verdict) of each (id, host, path) that a rule (host, path, verdict) fits: the longest; of equally long ones an allow.

    A host is looked up by its suffixes and a path by its prefixes of the lengths that rules of that
    host have: two equi-joins, no comparison of all urls with all rules.
    """
    r = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "verdict").distinct()
    lengths = r.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at_host = urls.select("id", "path", F.explode(suffixes).alias("rh")).join(lengths, "rh")
    cand = at_host.select("id", "rh", "path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    cand = cand.withColumn("rp", F.expr("substring(path, 1, n)")).join(r, ["rh", "rp"])
    best = F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), (F.col("verdict") == "allow").alias("ok"), F.concat("rh", "rp").alias("rule"), "verdict")).alias("m")
    return cand.groupBy("id").agg(best).select("id", "m.rule", "m.verdict")


def filter_urls(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str | None = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A page's own rule decides. Else its component over redirects (``redirects``: columns src, dst) and the
    canonical and refresh links in the html does: allow where any address of the component has an
    allow rule, else block where any has a block rule. Else the page is allowed.

    Null urls, or ones without ``://``, have an empty host and path, no links, and are allowed. Repeated rows are
    judged each for itself, also with a null page_id; null html has no links; an empty table gives an empty result.
    """
    have = pages.select(
        F.monotonically_increasing_id().alias("id"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        *([F.col(html).cast("string").alias("html")] if html else []),
    )
    judged = stash(have.select("id", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node")))
    own = best_rule(judged.select("id", "host", "path"), rules)
    edges = None
    if html:
        edges = page_edges(have)
    if redirects is not None:
        more = redirects.select(address(F.col("src")).alias("a"), address(F.col("dst")).alias("b")).where("a <> b")
        edges = more if edges is None else edges.union(more)
    out = judged.join(own.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
    if edges is not None:
        comp = components(edges)
        split = F.regexp_extract("node", r"^([^/?]*)", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
        ruled = best_rule(comp.select(F.col("node").alias("id"), split[0].alias("host"), split[1].alias("path")), rules)
        say = comp.join(ruled, comp.node == ruled.id).groupBy("component").agg(F.min("verdict").alias("spread"))  # "allow" < "block"
        spread = stash(comp.join(say, "component").select(F.col("node").alias("_node"), "spread"))
        # urls without a host would all meet under the null key
        key = F.coalesce("node", F.concat(F.lit(" "), F.col("id").cast("string")))
        out = out.withColumn("_key", key).join(spread, F.col("_key") == F.col("_node"), "left")
    else:
        out = out.withColumn("spread", F.lit(None).cast("string"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
