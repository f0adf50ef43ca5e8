"""Link selection over a table of pages (page_id, url, html)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.functions.text import column, strip, text
from roster.operators.dedupe import first_per_key

# Fixed values.
SECTION_FRAGMENT = "conv%C3%AAnios"
MENU_TEXTS = ("Página inicial", "CONVÊNIOS")
DRIVE_HOST, SITE_HOST, FOLDER_MARK = "drive.google.com", "sites.google.com", "/folders/"
DRIVE_ID_PATTERNS = (
    "/file/d/([a-zA-Z0-9_-]+)", "id=([a-zA-Z0-9_-]+)", "/folders/([a-zA-Z0-9_-]+)",
)
FILE_ENDINGS = (".pdf", ".doc", ".xls", ".csv", ".txt", ".zip", ".rar")
UNTITLED = "Página sem título"
BANKS = (
    "AMIGOZ", "BANCO DO BRASIL", "BANRISUL", "BMG", "BRB", "C6", "DAYCOVAL", "DIGIO", "FACTA",
    "GO! CONSIG", "ICRED", "INBURSA", "ITAU", "MASTER", "MERCANTIL", "OLE/SANTANDER", "PAN",
    "PRESENÇA BANK", "QUALIBANK", "QUALICARD", "QUERO+", "SAFRA", "TOTAL CASH", "V8",
)

# attributes may hold a ">" in quotes; possessive loops keep the matcher's stack flat
_ATTRIBUTES = r"""(?=[\s/])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_ANCHOR = rf"(?is)<a{_ATTRIBUTES}(.*?)</a>"
_ANCHORS_AND_BASE = rf"(?is)<base{_ATTRIBUTES}|<a{_ATTRIBUTES}.*?</a>"
_BASE = rf"(?is)<base{_ATTRIBUTES}"
_HREF = r"""(?is)(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
_ORIGIN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*"
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_NUMBER = "^&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def unescaped(name: str) -> Column:
    """The column's text with numeric entities and the named ones of HTML's own marks resolved, each once."""
    number = f"regexp_extract(p, r'{_NUMBER}', 1)"
    code = f"int(if(lower(left({number}, 1)) = 'x', conv(substring({number}, 2), 16, 10), {number}))"
    # no code point, no character: the entity stays
    character = f"if({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111, decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'), NULL)"
    marks = " ".join(
        f"WHEN startswith(p, '{entity}') THEN concat({quoted}, substring(p, {len(entity) + 1}))"
        for entity, quoted in ((e, f"'{c}'" if c != "'" else f'"{c}"') for e, c in _ENTITIES)
    )
    return F.expr(f"""
        CASE WHEN contains({name}, '&') THEN array_join(transform(split({name}, '(?=&)'), p -> CASE
            WHEN {number} <> '' THEN coalesce(concat({character}, regexp_replace(p, r'{_NUMBER}', '')), p) {marks} ELSE p END), '')
        ELSE {name} END""")


def without_dots(name: str) -> Column:
    """The column's whole address without the segments ``.`` and ``..`` in its path, the latter with the segment before."""
    origin, path = f"regexp_extract({name}, r'{_ORIGIN}', 0)", f"regexp_extract({name}, r'{_ORIGIN}([^?#]*)', 1)"
    kept = f"""aggregate(slice(split({path}, '/'), 2, greatest(size(split({path}, '/')) - 1, 0)), CAST(array() AS array<string>), (acc, s) ->
        CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN s = '.' THEN acc ELSE array_append(acc, s) END)"""
    folder = f"if({path} RLIKE r'/\\.\\.?$', array_append({kept}, ''), {kept})"
    rest = f"substring({name}, length({origin}) + length({path}) + 1)"
    return F.expr(f"""
        CASE WHEN contains({name}, '/.') AND {path} RLIKE r'/\\.\\.?(/|$)' THEN concat({origin}, '/', array_join({folder}, '/'), {rest})
        ELSE {name} END""")


def _joined(link: Column, base: Column) -> Column:
    """The address a link leads to from a page: absolute, host, root or folder relative, or a fragment."""
    scheme = F.regexp_extract(base, _SCHEME, 0)
    origin = F.regexp_extract(base, _ORIGIN, 0)
    path = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(path, r"^.*/", 0))
    return (
        F.when(link.rlike(_SCHEME), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), link))
        .when(link.startswith("?"), F.concat(path, link))
        .otherwise(F.concat(folder, link))
    )


def _with_target(rows: DataFrame, name: str, attributes: Column, base: str, href: str) -> DataFrame:
    """Add ``href``, the value in an anchor's attributes, and ``name``, its address from ``base``.

    In steps, each with a column of its own, so that Spark computes every step once per row.
    """
    raw = F.concat(*[F.regexp_extract(attributes, _HREF, i) for i in (1, 2, 3)])
    rows = rows.withColumn("_raw", raw).withColumn(href, unescaped("_raw")).withColumn("_link", strip(href))
    rows = rows.withColumn("_joined", _joined(F.col("_link"), F.col(base)))
    return rows.withColumn(name, without_dots("_joined")).drop("_raw", "_link", "_joined")


def extract_links(pages: DataFrame) -> DataFrame:
    """Every anchor with an href: ``page_id, url, position, href, target, text``.

    Values may be in double, single or no quotes. ``href`` is as written, entities resolved; ``target``
    is the address it leads to, from the page's ``<base>`` if it has one; tags in the text are removed. A page is searched
    once.
    """
    found = pages.select("page_id", "url", F.regexp_extract_all("html", F.lit(_ANCHORS_AND_BASE), F.lit(0)).alias("_tags"))
    is_base = lambda tag: F.lower(F.left(tag, F.lit(5))) == "<base"
    first = F.get(F.filter("_tags", lambda t: is_base(t) & F.regexp_extract(t, _BASE, 1).rlike(_HREF)), F.lit(0))
    found = found.withColumn("_of_base", F.coalesce(F.regexp_extract(first, _BASE, 1), F.lit("")))
    found = _with_target(found, "_base", F.col("_of_base"), "url", "_base_href")
    anchors = F.transform(
        F.filter("_tags", lambda t: ~is_base(t)),
        lambda t: F.struct(F.regexp_extract(t, _ANCHOR, 1).alias("attributes"), F.regexp_extract(t, _ANCHOR, 2).alias("text")),
    )
    linked = F.filter(anchors, lambda a: a["attributes"].rlike(_HREF))
    rows = found.select("page_id", "url", "_base", F.posexplode(linked).alias("position", "_a"))
    rows = _with_target(rows, "target", F.col("_a.attributes"), "_base", "href")
    rows = rows.withColumn("_plain", F.regexp_replace("_a.text", "(?s)<[^>]*>", ""))
    return rows.select("page_id", "url", "position", "href", "target", strip(unescaped("_plain")).alias("text"))


def filter_links(
    links: DataFrame, contains: str = SECTION_FRAGMENT, exclude_text: Sequence[str] = MENU_TEXTS
) -> DataFrame:
    """Links whose ``href`` holds a fragment, lead elsewhere and carry a text; first per page and ``href``."""
    wanted = links.where(
        F.contains("href", F.lit(contains))
        & (F.col("href") != F.col("url"))
        & (F.col("text") != "")
        & ~F.col("text").isin(*exclude_text)
    )
    return first_per_key(wanted, ["page_id", "href"], ["position"])


def drive_links(links: DataFrame, host: str = DRIVE_HOST, distinct: bool = False) -> DataFrame:
    """Links to the file store; ``distinct`` keeps each target once per page."""
    found = links.where(F.contains("href", F.lit(host)))
    return first_per_key(found, ["page_id", "href"], ["position"]) if distinct else found


def drive_id(url: Column | str) -> Column:
    """File or folder id in a store link; null when there is none."""
    return F.coalesce(
        *[F.nullif(F.regexp_extract(column(url), p, 1), F.lit("")) for p in DRIVE_ID_PATTERNS]
    )


def strip_query(url: Column | str) -> Column:
    return F.substring_index(column(url), "?", 1)


def is_folder(url: Column | str) -> Column:
    return F.contains(column(url), F.lit(FOLDER_MARK))


def file_names(links: DataFrame, per_page: int | None = None) -> DataFrame:
    """Elements whose text names a file; with ``per_page`` only of the first so many of each page."""
    ending = "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS)
    first = links if per_page is None else links.where(F.col("position") < per_page)
    return first.where(F.lower("text").rlike(ending))


def site_url_ok(url: Column | str, host: str = SITE_HOST) -> Column:
    """Web address on the given host."""
    value = F.coalesce(text(url), F.lit(""))
    return value.rlike("^https?://") & F.contains(value, F.lit(host))


def page_title(html: Column | str, default: str = UNTITLED) -> Column:
    title = strip(F.regexp_extract(column(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(default))


def mentions_bank(value: Column | str, banks: Sequence[str] = BANKS) -> Column:
    """Does the upper-cased text hold a known bank name?"""
    upper = F.upper(text(value))
    found = F.lit(False)
    for name in banks:
        found = found | F.contains(upper, F.lit(name))
    return F.coalesce(found, F.lit(False))
