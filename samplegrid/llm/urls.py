"""URL filters with redirect equivalence, in DataFrame functions only.

A page's own rule decides first (longest fitting rule; an allow rule is explicit). A page without a rule takes the
verdict of its aliases: pages are linked by redirects (meta refresh, a redirect table) and canonical links, components
of these links share block decisions, and an explicit allow among the aliases takes precedence over a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.common import BROADCAST_ROWS, by_key, connected_components, discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules in use, (kind, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: An attribute's value in double quotes, in single quotes, or bare.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Tags that name another address, whole, and their attributes. Attributes in quotes may hold any sign.
TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
COMMENT = r"(?s)<!--.*?(?:-->|\z)"


def attribute(tag, name: str):
    """The value of an attribute of a tag; '' if it has none."""
    pattern = rf"(?is)^<\w+(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s{name}\s*=\s*{VALUE}"
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def host(url: str):
    """What follows the first :// up to / ? # or the end, A-Z lowered; '' for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: str):
    """What follows the host up to ? # or the end; '' for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def identity(url: str):
    """What makes two URLs the same address: host without www., path without a closing slash, query; '' if there is no host."""
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^?#]*(\?[^#]*)", 1)
    name = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(name == "", "").otherwise(F.concat(name, F.regexp_replace(path(url), "/+$", ""), query))


def resolve(base: str, target: str):
    """What a link target means on the page base: targets with a scheme stay, // takes the scheme, / the host, ? the path and
    others the folder of the page; . and .. steps are taken out. '' for fragments and for relative targets of hostless pages."""
    t, own = F.col(target), path(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_replace(own, "[^/]*$", ""))
    local = F.when(t.startswith("/"), t).when(t.startswith("?"), F.concat(own, t)).otherwise(F.concat(folder, t))
    steps = F.filter(F.split(F.regexp_extract(local, r"^[^?#]*", 0), "/"), lambda x: x != ".")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    steps = F.aggregate(steps, F.expr("cast(array() as array<string>)"), lambda a, x: F.when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    local = F.concat(F.array_join(steps, "/"), F.regexp_extract(local, r"^[^?#]*(.*)", 1))
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when((host(base) == "") | t.startswith("#"), "")
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .otherwise(F.concat(scheme, F.lit("://"), host(base), local))
    )


def rule(rules: list[tuple[str, str, str]] = RULES):
    """The longest rule that fits columns host and path, as struct(kind, text); null if none fits."""
    out = F.lit(None).cast("struct<kind:string,text:string>")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.lit(h + p).alias("text"))).otherwise(out)
    return out


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None, every: bool = True) -> DataFrame:
    """(a, b): addresses that stand for each other, from canonical links and meta refreshes of the pages and from
    redirects(source, target). All refreshes count, and all canonical links of a page, or its first one only (every=False); rel may list
    other words besides. Tags inside comments count for nothing. Relative targets are resolved against the page, or against its first <base href>;
    &amp; is read as &; links to the same address give no edge."""
    # few pages have such links; the others are passed by with one search
    found = pages.where(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv\s*=\s*[\"']?refresh"))
    tags = F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(TAG), F.lit(0))
    found = found.select("url", tags.alias("tags")).withColumn("base", F.get(F.filter(F.transform("tags", lambda t: F.when(t.rlike("(?i)^<base"), attribute(t, "href"))), lambda x: x != ""), F.lit(0)))
    # (whether it is a refresh, target) of each tag in order
    link = F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<link") & attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")), lambda t: attribute(t, "href"))
    if not every:
        link = F.slice(F.filter(link, lambda x: x != ""), 1, 1)
    jump = F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<meta") & attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")), lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"']*?)[\"']?\s*$", 1))
    found = found.select("url", "base", F.explode(F.concat(link, jump)).alias("target"))
    if redirects is not None:
        found = found.union(redirects.select(F.col("source").alias("url"), F.lit(None).cast("string").alias("base"), "target"))
    found = found.where("trim(target) <> ''").select("url", *(F.replace(F.trim(c), F.lit("&amp;"), F.lit("&")).alias(c) for c in ("base", "target")))
    found = found.withColumn("base", F.when(F.col("base").isNotNull(), resolve("url", "base"))).withColumn("base", F.coalesce(F.nullif("base", F.lit("")), F.col("url")))
    found = found.select("url", F.when(F.col("target").startswith("#"), "").otherwise(resolve("base", "target")).alias("target"))
    return found.select(identity("url").alias("a"), identity("target").alias("b")).where("a <> '' and b <> '' and a <> b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, every: bool = True) -> DataFrame:
    """(page_id, host, path, rule, verdict, by) for every row of pages(page_id, url, html, ...).

    by: rule, alias or default. Null or hostless URLs fit no rule and have no aliases: allowed by default. Repeated rows
    are judged alike; null page_ids are kept; other columns are not read; an empty table gives an empty result. every: see
    alias_edges().
    """
    own = pages.select("page_id", "url").withColumn("host", host("url")).withColumn("path", path("url"))
    own = own.withColumn("r", rule(rules)).withColumn("id", identity("url"))
    edges = materialize(alias_edges(pages.select("url", "html"), redirects, every), "aliases")
    comp = materialize(connected_components(edges), "addresses")
    # decisions of the linked addresses only: grouped maxima by address, then by component
    linked = comp.select(F.col("node").alias("id"), "component")
    decided = own.where("r is not null and id <> ''").groupBy("id").agg(F.max((F.col("r.kind") == "allow").cast("int")).alias("allowed"))
    known = linked.join(decided, "id").groupBy("component").agg(F.max("allowed").alias("allowed"))
    known = materialize(linked.groupBy("component").agg(F.count("*").alias("n")).join(known, "component"), "known")
    inherited = materialize(by_key(linked, known, "component", comp.count()).select("id", "allowed"), "inherited")
    if inherited.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = own.join(F.broadcast(inherited), "id", "left")
    else:
        # popular addresses and pages without a host are not gathered
        hosted = own.where("id <> ''")
        pages_of = inherited.join(hosted.groupBy("id").agg(F.count("*").alias("n")), "id")
        out = by_key(hosted, materialize(pages_of, "popular"), "id", pages.count(), "left").unionByName(own.where("id = ''").withColumn("allowed", F.lit(None).cast("int")))
    discard(edges, known)
    verdict = F.when(F.col("r").isNotNull(), F.col("r.kind")).when(F.col("allowed") == 0, "block").otherwise("allow")
    by = F.when(F.col("r").isNotNull(), "rule").when(F.col("allowed").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", F.col("r.text").alias("rule"), verdict.alias("verdict"), by.alias("by"))
