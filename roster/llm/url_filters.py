"""Allow and block rules for urls, carried over redirects and canonical links.

A rule names a host, all of whose subdomains it covers, and the start of a path. The longest fitting rule
decides a url. A url without a rule may still be another name of one that has a rule: pages redirect, and
name their canonical address. The addresses so tied are connected components, found by rounds of joins;
a component that has a blocked address blocks all its addresses without a rule of their own, unless it
has an explicitly allowed one, which comes first. What no rule reaches in either way is allowed.

Rules are joined by equal keys, (host suffix, path prefix), with the lengths of path that the rules of a host
have. So neither a host with most of the urls nor one with most of the rules makes a task that sees all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.common import stored
from roster.llm.components import components

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit, not a page.
TRACKING = r"utm_[a-z_]+|gclid|fbclid"


# --- urls ------------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The form in which urls of one page are equal: no scheme, fragment, default port or tracking parameters.

    Null for urls without ``://`` or without a host.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?s)^(?:{TRACKING})(?:=.*)?$")), "&")
    at = F.regexp_replace(host(url), r":(?:80|443)?$", "")
    where = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(at != "", F.concat(at, where, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(href: Column, base: Column) -> Column:
    """The url that a link of the page ``base`` names: whole, with the page's scheme, host or folder where it has none.

    Blanks around it go; dot segments stay as they are. Null for other schemes, such as ``mailto:``.
    """
    link = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.concat(site, F.regexp_extract(F.concat(path(base), F.lit("")), r"(?s)^(.*/)?", 1))
    return (
        F.when(link == "", None)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(whole, link))
        .otherwise(F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), link))
    )


# --- aliases ---------------------------------------------------------------------------------------

# comments and scripts are matched first, so tags in them don't count
_TAGS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|(<(?:link|meta)\s[^>]*>)"
_CANONICAL = r"""(?is)\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CONTENT = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_TARGET = r"""(?is)^[^;,]*[;,]\s*url\s*=\s*['"]?([^'"]*)"""


def _value(tag: Column, pattern: str, groups: int) -> Column:
    return F.concat(*[F.regexp_extract(tag, pattern, g + 1) for g in range(groups)])


def _links(html: Column) -> Column:
    """The targets of a page's canonical links and refreshes, as they are written."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(_TAGS), 1), lambda t: t != "")
    target = lambda t: (
        F.when((F.lower(F.substring(t, 1, 5)) == "<link") & t.rlike(_CANONICAL), _value(t, _HREF, 3))
        .when((F.lower(F.substring(t, 1, 5)) == "<meta") & t.rlike(_REFRESH), F.regexp_extract(_value(t, _CONTENT, 2), _TARGET, 1))
    )
    return F.filter(F.transform(tags, lambda t: F.replace(target(t), F.lit("&amp;"), F.lit("&"))), lambda x: x.isNotNull())


def page_aliases(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): urls of pages and what their canonical links and refreshes name. Null urls and pages have none."""
    found = pages.select(F.col(url).alias("a"), F.explode(_links(F.col(html))).alias("href"))
    return found.select("a", resolved(F.col("href"), F.col("a")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")


# --- rules -----------------------------------------------------------------------------------------


def _suffixes(name: Column, longest: int) -> Column:
    """A host and all domains over it, but for those longer than any rule's."""
    # cut first, so that a host of very many labels has few suffixes; what the cut tears is too long and goes
    labels = F.split(F.right(name, F.lit(longest + 1)), r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), ".")
    )
    return F.filter(ends, lambda e: F.length(e) <= longest)


def match(urls: DataFrame, rules: DataFrame, key: str, at: str = "host", where: str = "path") -> DataFrame:
    """(key, rule, verdict) of the rows of ``urls`` that a rule of ``rules`` (host, path, verdict) fits.

    The rule with the longest text, host and path, wins; of equally long ones the longer host, and of equal rules
    allow. Rows with equal ``key`` must have equal host and path; rows with a null key have no rule.
    """
    rules = stored(rules.select(
        F.translate("host", _UPPER, _LOWER).alias("_rule_host"), F.coalesce("path", F.lit("")).alias("_rule_path"), "verdict"
    ).filter("_rule_host <> '' AND verdict IS NOT NULL"), "rules")
    longest = rules.agg(F.max(F.length("_rule_host"))).first()[0] or 0
    lengths = stored(
        rules.groupBy("_rule_host").agg(F.collect_set(F.length("_rule_path")).alias("_lengths"))
        .withColumnRenamed("_rule_host", "_covered"),
        "lengths",
    )
    asked = urls.select(F.col(key).alias("_key"), F.col(at).alias("_host"), F.col(where).alias("_path"))
    # hosts are few beside urls: their suffixes are looked up once each
    hosts = asked.select("_host").distinct()
    covers = stored(
        hosts.select("_host", F.explode(_suffixes(F.col("_host"), longest)).alias("_covered")).join(lengths, "_covered"), "covers"
    )
    keys = asked.filter("_key IS NOT NULL").join(covers, "_host").select(
        "_key", F.col("_covered").alias("_rule_host"), "_path",
        F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"),
    ).select("_key", "_rule_host", F.substring("_path", F.lit(1), F.col("_n")).alias("_rule_path"))
    size = F.length("_rule_host") + F.length("_rule_path")
    best = F.max(F.struct(
        size.alias("size"), F.length("_rule_host").alias("host"), (F.col("verdict") == ALLOW).alias("allow"),
        F.concat("_rule_host", "_rule_path").alias("rule"), "verdict",
    ))
    found = keys.join(rules, ["_rule_host", "_rule_path"]).groupBy("_key").agg(best.alias("_best"))
    return found.select(F.col("_key").alias(key), F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))


def alias_verdicts(aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, verdict) of every address of ``aliases`` (a, b: urls) that is tied to one with a rule."""
    edges = stored(aliases.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")).filter("a <> b").distinct(), "aliases")
    groups = components(edges)
    nodes = stored(
        groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
        .withColumn("_url", F.concat(F.lit("any://"), F.col("node"))), "nodes",
    )
    decided = match(nodes.select("node", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path")), rules, "node")
    # one row for each component: an explicit allow in it comes before any block
    by_group = nodes.join(decided, "node").groupBy(F.col("root").alias("_root")).agg(
        F.when(F.bool_or(F.col("verdict") == ALLOW), ALLOW).otherwise(BLOCK).alias("verdict")
    )
    return nodes.join(stored(by_group, "groups"), F.col("root") == F.col("_root")).select(F.col("node").alias("address"), "verdict")


def judge(pages: DataFrame, rules: DataFrame, aliases: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``.

    ``rules``: (host, path, verdict), verdict ``allow`` or ``block``. ``aliases``: (a, b), urls that are one page, such as
    the redirects a crawler saw; by default the canonical links and refreshes in the column ``html``.

    A url's own rule decides; without one, the rules of addresses tied to it do, allow before block; else it is
    allowed. A null url, or one without ``://``, has empty host and path and no rule, and is allowed. Repeated rows,
    null keys and any number of rows with one url are kept as they are. Other columns of ``pages`` are ignored.
    """
    if aliases is None:
        aliases = page_aliases(pages, url)
    tied = stored(alias_verdicts(aliases, rules), "tied")
    # what decides a url is its host and path; equal ones are looked up once
    seen = pages.select(F.col(key), F.col(url).alias("_url")).withColumns(
        {"host": host(F.col("_url")), "path": path(F.col("_url")), "_address": address(F.col("_url"))}
    )
    place = F.concat("host", F.lit("\x00"), "path")
    places = seen.select(place.alias("_place"), "host", "path").distinct()
    decided = stored(match(places, rules, "_place").withColumnRenamed("verdict", "_verdict"), "decided")
    tied = tied.select(F.col("address").alias("_tied"), F.col("verdict").alias("_of_tied"))
    joined = seen.withColumn("_place", place).join(decided, "_place", "left").join(tied, F.col("_address") == F.col("_tied"), "left")
    return joined.select(
        key, "host", "path", "rule", F.coalesce("_verdict", "_of_tied", F.lit(ALLOW)).alias("verdict")
    )
