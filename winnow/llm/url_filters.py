"""URL rules whose block decisions reach the aliases of a page.

A url is judged by the longest rule that fits it. Urls without a rule take the verdict of their
equivalence class: the connected component over redirect, canonical-link and address-form edges. An
explicit allow in the class goes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.components import connected_components
from winnow.llm.store import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Query parameters that name a visit and not a page.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased, else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """A url without what servers redirect away: scheme, ``www.``, tracking parameters, a last ``/`` and the fragment.

    Null for a url without ``://``: such urls have no aliases.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    plain = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/$", ""))
    return F.when(url.contains("://"), F.when(kept != "", F.concat(plain, F.lit("?"), kept)).otherwise(plain))


def links_in(html: Column) -> Column:
    """Targets of all canonical links and refreshing redirects in a page, as they stand there."""
    canonical = F.when(
        F.lower(html).contains("canonical"),
        F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (
            r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""",
            r"""(?i)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*\brel\s*=\s*["']?canonical\b""",
        )]),
    ).otherwise(F.array().cast("array<string>"))
    refresh = F.when(
        F.lower(html).contains("http-equiv"),
        F.regexp_extract_all(html, F.lit(r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*['"]?([^"'\s>]+)"""), F.lit(1)),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(canonical, refresh))


def resolved(base: Column, target: Column) -> Column:
    """``target`` as a url, seen from the page ``base``; null for other schemes (``mailto:``) and from a base without ``://``."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?):", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = F.when(path == "", path_of(base)).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path_of(base), r"(?s)[^/]*$", ""), "^/", ""), path))
    parts = F.when(full.rlike(r"(^|/)\.\.?$"), F.concat(full, F.lit("/"))).otherwise(full)
    kept = F.aggregate(
        F.split(F.regexp_replace(parts, "^/", ""), "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(site == "", None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, F.lit("/"), F.array_join(kept, "/"), rest))
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` with the longest fitting ``rule`` and its ``action``; among equals an allow wins.

    A host meets the rules on the names of itself and of the domains above it, so rules are found
    by an equi-join however many there are.
    """
    parts = F.split(host_of(F.col("url")), r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    wide = urls.select("url").distinct().select("url", path_of(F.col("url")).alias("path"), F.explode(names).alias("rule_host"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action")).alias("best")
    return (
        wide.join(rules, "rule_host").filter(F.expr("startswith(path, rule_path)")).withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("url").agg(best).select("url", "best.rule", "best.action")
    )


def url_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct (``src``, ``dst``) urls of links in the pages and of ``redirects``, which may come from a crawl log."""
    found = pages.select(F.col("url").alias("src"), F.explode(links_in(F.col("html"))).alias("dst")).withColumn("dst", resolved(F.col("src"), F.col("dst"))) if "html" in pages.columns else None
    given = redirects.select("src", "dst") if redirects is not None else None
    both = given if found is None else found if given is None else found.unionByName(given)
    if both is None:
        both = pages.select(F.col("url").alias("src"), F.col("url").alias("dst")).limit(0)
    return saved(both.filter("src <> dst").distinct())


def equivalence(urls: DataFrame) -> DataFrame:
    """(``address``, ``component``) of the addresses that an edge of ``urls`` joins to another one.

    Only distinct edges enter the graph; its rounds are kept in the shared folder.
    """
    edges = saved(urls.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")).filter("src <> dst").distinct())
    return connected_components(edges).select(F.col("node").alias("address"), "component")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A null url, or one without ``://``, has an empty host and path, no rule and no alias, and is
    allowed. Repeated rows keep their number; columns with the names of results are replaced.
    """
    edges = url_edges(pages, redirects)
    # Ends of edges that are no page are judged too, as their verdict reaches the pages of their class.
    urls = pages.select("url").unionByName(edges.select(F.col("src").alias("url"))).unionByName(edges.select(F.col("dst").alias("url")))
    by_url = match_rules(urls.filter("url is not null"), rules).withColumn("address", address(F.col("url")))
    classes = equivalence(edges)
    named = F.coalesce("component", "address")
    judged = (
        by_url.join(classes, "address", "left").groupBy(named.alias("_class"))
        .agg(F.max(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("_allow"))
    )
    # Only classes with a rule are here, so a class without an explicit allow has a block.
    out = pages.select(*[c for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]).withColumn("address", address(F.col("url")))
    return (
        out.join(by_url.select("url", "rule", "action"), "url", "left").join(classes, "address", "left").withColumn("_class", named)
        .join(judged, "_class", "left")
        .withColumn("verdict", F.coalesce("action", F.when(F.col("_allow") == 0, "block").otherwise("allow")))
        .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        .select(*[c for c in pages.columns if c not in {"host", "path", "rule", "verdict"}], "host", "path", "rule", "verdict")
    )


#: For pages without canonical links and redirects, as in the given tables; the tests cover those that have some.
SQL_OP9 = r"""
WITH p AS (SELECT page_id, url,
    lower(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
    COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
    FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT p.*, m.rule, m.action FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (page_id)),
a AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || COALESCE('?' || NULLIF(array_to_string(list_filter(
    string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)')), '&'), ''), '') AS addr FROM best),
c AS (SELECT addr, max(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) AS ok FROM a WHERE action IS NOT NULL GROUP BY addr)
SELECT page_id, host, path, rule, COALESCE(action, CASE WHEN c.ok = 0 THEN 'block' ELSE 'allow' END) AS verdict FROM a LEFT JOIN c USING (addr)
"""
