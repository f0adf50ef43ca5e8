"""Link extraction from pages."""

from pyspark.sql import functions as F

from queries.registry import query
from roster.operators import links

# by string splitting, so independent of the operator's patterns; the pages have anchors of one form only
LINKS = """p AS (SELECT page_id, url, list_slice(string_split(html, '<a href="'), 2, 100000) AS pieces FROM pages),
a AS (SELECT page_id, url, unnest(pieces) AS piece, unnest(range(len(pieces)))::INTEGER AS position FROM p),
b AS (SELECT page_id, url, position, split_part(piece, '"', 1) AS raw, split_part(substr(piece, strpos(piece, '>') + 1), '</a>', 1) AS body FROM a),
links AS (SELECT page_id, url, position, replace(replace(replace(replace(raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href,
  CASE WHEN starts_with(href, '/') THEN string_split(url, '/')[1] || '//' || string_split(url, '/')[3] || href ELSE href END AS target,
  trim(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'gs'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text FROM b)"""
FIRST = "QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY position) = 1"


@query("page_links", f"WITH {LINKS} SELECT * FROM links")
def _(t):
    return links.extract_links(t.pages)


@query(
    "link_filter",
    f"WITH {LINKS} SELECT * FROM links WHERE contains(href, '/th') AND href <> url AND text <> '' AND text NOT IN ('the', 'The') {FIRST}",
)
def _(t):
    return links.filter_links(links.extract_links(t.pages), "/th", ["the", "The"])


@query("link_distinct", f"WITH {LINKS} SELECT * FROM links WHERE contains(href, 'an') {FIRST}")
def _(t):
    return links.drive_links(links.extract_links(t.pages), "an", distinct=True)


@query("link_host", f"WITH {LINKS} SELECT * FROM links WHERE contains(href, 'th')")
def _(t):
    return links.drive_links(links.extract_links(t.pages), "th")


@query(
    "drive_ids",
    f"""WITH {LINKS} SELECT page_id, position, CASE WHEN regexp_extract(href, '([a-zA-Z0-9_-]+)', 1) = '' THEN NULL
      ELSE regexp_extract(href, '([a-zA-Z0-9_-]+)', 1) END AS id,
      CASE WHEN position % 3 = 2 THEN true ELSE false END AS folder FROM links""",
)
def _(t):
    """Store links of the three forms are made from the page links."""
    found = links.extract_links(t.pages)
    name = F.regexp_extract("href", "([a-zA-Z0-9_-]+)", 1)
    kind = F.col("position") % 3
    url = F.concat(
        F.lit("https://drive.google.com"),
        F.when(kind == 0, F.concat(F.lit("/file/d/"), name, F.lit("/view?x=1")))
        .when(kind == 1, F.concat(F.lit("/open?id="), name))
        .otherwise(F.concat(F.lit("/drive/folders/"), name)),
    )
    return found.select("page_id", "position", links.drive_id(url).alias("id"), links.is_folder(url).alias("folder"))


@query(
    "page_urls",
    """SELECT page_id, split_part(url, '?', 1) AS plain, regexp_matches(url, '^https?://') AND contains(url, 'example.org') AS ok FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id", links.strip_query("url").alias("plain"), links.site_url_ok("url", "example.org").alias("ok")
    )


@query(
    "file_names",
    f"WITH {LINKS} SELECT page_id, position, text FROM links WHERE (position % 2 = 0 OR regexp_matches(lower(text), '\\.pdf|\\.doc|\\.xls|\\.csv|\\.txt|\\.zip|\\.rar'))",
)
def _(t):
    """Every other link text is given a file ending."""
    found = links.extract_links(t.pages)
    named = found.withColumn("text", F.when(F.col("position") % 2 == 0, F.concat("text", F.lit(".PDF"))).otherwise(F.col("text")))
    return links.file_names(named).select("page_id", "position", F.regexp_replace("text", r"\.PDF$", "").alias("text"))


@query(
    "page_titles",
    """SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'Página sem título') AS title FROM pages""",
)
def _(t):
    return t.pages.select("page_id", links.page_title("html").alias("title"))


@query(
    "mentions_bank",
    "SELECT doc_id, " + " OR ".join(f"contains(upper(text), '{b}')" for b in links.BANKS) + " AS named FROM documents",
)
def _(t):
    return t.documents.select("doc_id", links.mentions_bank("text").alias("named"))
