import pytest
from pyspark.sql import functions as F

from roster.llm import url_filters
from roster.llm.queries import RULES


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def pages_of(spark, rows):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, None))) for i, r in enumerate(rows)], "page_id long, url string, html string")


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host, tail = rest[: ends[0]], rest[ends[0] :]
    ends = [i for i, c in enumerate(tail) if c in "?#"] + [len(tail)]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[: ends[0]]


def own_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


URLS = [
    "http://www.example.com/en/1", "http://m.example.com/en/1", "https://example.com/en", "http://example.com/de/x", "http://x.net/fr/1",
    "http://x.net/FR/1", "HTTP://A.NET/es/?q#f", "http://net/es/", "http://internet/es/", "http://x.org/fr/1", "http://com", "http://com/",
    "http://a.com?x=/en/", "http://a.com#/en/", "ftp://b.example.com/en/#://c", "no scheme", "", None, "://example.com/en/", "a\nb://x.net/fr/\n",
    "http://user@x.net:80/fr/", "http://x.net:8080/fr/", "http://" + "l." * 3000 + "net/fr/", "http://x.net/fr/" + "p/" * 9000, "http://É.net/fr/é",
    "http://.net/fr/", "http://x.net./fr/", "http://example.com/en/", "http://example.com/en/",
]


def test_own_rules(spark, rules):
    pages = pages_of(spark, URLS).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "_url", "_place")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    for i, url in enumerate(URLS):
        host, path = split_url(url)
        rule, verdict = own_rule(host, path, RULES)
        assert got[i] == (host, path, rule, verdict or "allow"), url
    assert len(got) == len(URLS)


def canonical(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


def refresh(href):
    return f"<meta http-equiv='Refresh' content=\"0; URL='{href}'\">"


def test_aliases_carry_blocks_and_allows(spark, rules):
    pages = pages_of(spark, [
        ("http://a.org/1", canonical("http://x.net/fr/9")),  # 0: its canonical page is blocked
        ("http://b.org/1", refresh("http://a.org/1")),  # 1: and so is what leads there
        ("http://c.org/1", canonical("http://b.org/1?utm_source=feed#top")),  # 2: tracking and fragment are no part of a page
        ("https://d.org/1/2", canonical("../../e")),  # 3: no rule in reach
        ("http://f.net/en/1", canonical("//y.net/es/1")),  # 4: same scheme
        ("http://g.net/en/1", canonical("http://f.net/en/1")),  # 5
        ("http://h.com/1", canonical("http://x.net/fr/9")),  # 6: its own rule allows it, and comes before all aliases of it
        ("http://i.org/1", "<!-- " + canonical("http://x.net/fr/1") + " --><script>" + canonical("http://x.net/fr/1") + "</script>"),  # 7: not tags
        ("http://j.org/1", '<link rel="canonicals" href="http://x.net/fr/1"><link rel=alternate href="http://x.net/fr/1">'),  # 8
        ("http://k.org/a/b", "<LINK href=/fr/1 REL=canonical >"),  # 9: of its own host
        ("http://l.net/a", "<link href=/fr/1 rel=canonical >"),  # 10
        ("http://m.org/1", canonical("mailto:x@x.net")), ("no url", canonical("http://x.net/fr/1")), (None, canonical("http://x.net/fr/1")),  # 11 to 13
        ("http://n.org/1", canonical("http://n.org/1")), ("http://n.org/1", None), ("http://o.org/1#x", canonical("http://o.org/2")),  # 14 to 16
        ("https://o.org/2?utm_medium=a&gclid=1", canonical("http://z.net/fr/1?a=1&amp;b=2")),  # 17
    ])
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    # 0 to 2 and 6 are one component: what h.com is allowed comes first
    assert [got[i] for i in (0, 1, 2, 6)] == [(None, "allow")] * 3 + [("com/", "allow")]
    blocked = {i for i, (_, verdict) in got.items() if verdict == "block"}
    assert blocked == {4, 5, 10, 16, 17} and all(got[i][0] is None for i in blocked)
    without = url_filters.judge(pages.where("page_id <> 6"), rules)
    assert {r.page_id for r in without.where("verdict = 'block'").collect()} == blocked | {0, 1, 2}


def test_long_chain_and_hub_of_redirects(spark, rules):
    chain = [(f"http://c{i}.org/", f"http://c{i + 1}.org/") for i in range(120)] + [("http://c120.org/", "http://bad.net/fr/")]
    hub = [(f"http://h{i}.org/{i}", "http://hub.org/") for i in range(500)] + [("http://hub.org/", "http://bad.net/es/x")]
    aliases = spark.createDataFrame([*chain, *hub, ("http://free.org/", "http://other.org/"), (None, "http://c0.org/")], "a string, b string")
    pages = pages_of(spark, ["http://c0.org", "http://h7.org/7", "https://free.org/", "http://c119.org/?x=1"])
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, rules, aliases).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_many_rules_of_one_host(spark):
    """The longest wins, also among thousands; allow before block for equal ones; blank and null rules fit nothing."""
    many = [("h.org", f"/p{i}/", "block") for i in range(3000)] + [("h.org", "/p7/ok", "allow"), ("org", "/p7/ok/long", "block"), ("h.org", "", "allow")]
    many += [("H.org", "/same", "block"), ("h.org", "/same", "allow"), (None, "/", "block"), ("", "/", "block"), ("h.org", None, "allow"), ("h.org", "/x", None)]
    rules = spark.createDataFrame(many, "host string, path string, verdict string")
    pages = pages_of(spark, ["http://h.org/p7/x", "http://h.org/p7/okay", "http://a.h.org/p2999/", "http://h.org/", "http://h.org/same", "http://o.org/p7/ok/longer"])
    got = [(r.rule, r.verdict) for r in url_filters.judge(pages, rules).orderBy("page_id").collect()]
    assert got == [
        ("h.org/p7/", "block"), ("h.org/p7/ok", "allow"), ("h.org/p2999/", "block"), ("h.org", "allow"), ("h.org/same", "allow"), ("org/p7/ok/long", "block"),
    ]


def test_empty_tables(spark, rules):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(none, rules).collect() == []
    pages = pages_of(spark, ["http://a.org/", None])
    got = url_filters.judge(pages, rules.where("false")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("a.org", "/", None, "allow"), ("", "", None, "allow")]
