"""URL rules that follow redirects and canonical links.

Pages and the addresses they redirect to, or name as their canonical one, form a graph.  Its
connected components are computed on DataFrames; an explicit allow anywhere in a component wins
over a block, and a block reaches every alias that no rule names itself.  DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Query parameters that never change what an address shows.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> dict[str, Column]:
    """host, path and key; no ``://`` gives empty parts and a NULL key.  The key leaves out scheme, fragment, tracking."""
    scheme = F.locate("://", url)
    rest = F.when(scheme > 0, F.substring(url, scheme + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    key = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), "key": key}


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, allow before block at equal length; NULL if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def link_targets(html: Column, host: Column, path: Column) -> Column:
    """Absolute addresses of canonical links and meta refreshes in a page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical")),
        lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh")),
        lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/"))

    def absolute(t: Column) -> Column:
        t = F.replace(t, F.lit("&amp;"), F.lit("&"))
        return (
            F.when(t.contains("://"), t)
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(t.startswith("/"), F.concat(F.lit("http://"), host, t))
            .otherwise(F.concat(F.lit("http://"), host, folder, t))
        )

    return F.transform(F.filter(F.concat(canonical, refresh), lambda t: t != ""), absolute)


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (from_url, to_url): canonical links and refreshes of the pages, and recorded redirects."""
    parts = url_parts(F.col("url"))
    edges = pages.where("html is not null and url is not null").select(
        F.col("url").alias("from_url"),
        F.explode(link_targets(F.col("html"), parts["host"], parts["path"])).alias("to_url"),
    )
    if redirects is not None:
        edges = edges.union(redirects.select("from_url", "to_url"))
    return edges


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule and verdict, one row per input row.

    A url that a rule fits takes its verdict.  Others take that of their component: allow if a
    member is explicitly allowed, else block if a member is blocked, else allow.  NULL urls and
    urls without ``://`` have no aliases and are allowed; NULL pages have no links; repeated rows
    are judged alike; no rows give none; other columns are not read.
    """
    links = alias_edges(pages.select("url", "html"), redirects)
    ends = []
    for side in ("from_url", "to_url"):
        parts = url_parts(F.col(side))
        ends.append(F.struct(
            parts["key"].alias("key"), matched_rule(parts["host"], parts["path"], rules)["verdict"].alias("verdict")
        ).alias(side))
    linked = materialize(links.select(*ends).where("from_url.key is not null and to_url.key is not null"), "aliases")
    roots = components(linked.select(F.col("from_url.key").alias("a"), F.col("to_url.key").alias("b")), "a", "b")
    # the verdict of a rule depends on the key alone, so every member shows it at one of its links
    members = linked.select("from_url.*").union(linked.select("to_url.*")).distinct()
    verdicts = (
        roots.join(members, roots["node"] == members["key"])
        .groupBy("root")
        .agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
        .where("blocked and not coalesce(allowed, false)")
    )
    blocked = materialize(roots.join(verdicts, "root").select(F.col("node").alias("key")), "blocked")

    parts = url_parts(F.col("url"))
    judged = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), parts["host"].alias("host"), parts["path"].alias("path"),
        parts["key"].alias("key"),
    ).withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    return judged.join(blocked.withColumn("alias", F.lit("block")), "key", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "alias", F.lit("allow")).alias("verdict"),
    )
