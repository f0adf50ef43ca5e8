"""SQL of the queries on words, manifests and urls."""

from __future__ import annotations

from roster.llm import url_filters

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# crc32 by its table of 256 remainders, over a list of bytes
_CRC_TABLE = """
    crc_table AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
            FROM range(256) r(i)
        )
    )"""


def _crc(data: str) -> str:
    # text in ASCII and U+00C0 to U+00FF
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({data}, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


OP11 = f"""
    WITH RECURSIVE {_CRC_TABLE}, runs AS (
        SELECT doc_id, run, count(*) AS k FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {UPPER_LOWER}) AS run FROM documents
        ) GROUP BY ALL
    ), hashed AS (
        SELECT run, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table
    ), words AS (
        SELECT word, sum(k)::BIGINT AS n FROM (
            SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word
            FROM hashed
        ) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
    ), skips AS (
        SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
        SELECT a.word, b.word AS other FROM skips a JOIN skips b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail
        WHERE a.word <> b.word
        UNION SELECT s.word, w.word FROM skips s JOIN words w ON w.word = s.head || s.tail
        UNION SELECT w.word, s.word FROM skips s JOIN words w ON w.word = s.head || s.tail
    ), best AS (
        SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS other, max(o.n) AS other_n
        FROM near JOIN words o ON o.word = other GROUP BY near.word
    ), forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
            CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN best USING (word)
    ), walk AS (
        SELECT word, word AS reached FROM forms
        UNION SELECT walk.word, form FROM walk JOIN forms f ON f.word = reached WHERE form IS NOT NULL
    ), roots AS (
        SELECT walk.word, reached AS root FROM walk JOIN forms f ON f.word = reached WHERE f.form IS NULL
    )
    SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)
"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """Levels of a tree over ``leaves`` (g, pos, size, h), its last nodes, and each leaf's siblings level by level."""
    parts = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        parts.append(f"""{name}{k + 1} AS (
            SELECT g, pos // 16 AS pos, (size + 15) // 16 AS size, sha256(string_agg(h, '' ORDER BY pos)) AS h, list(h ORDER BY pos) AS kids
            FROM {name}{k} WHERE size > 1 GROUP BY g, pos // 16, (size + 15) // 16
        )""")
    tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE size = 1" for k in range(levels + 1))
    parts.append(f"{name}_top AS ({tops})")
    parts.append(f"{name}_path0 AS (SELECT g, pos, pos AS p, []::STRUCT(l VARCHAR, r VARCHAR)[] AS path FROM {name}0)")
    for k in range(levels):
        parts.append(f"""{name}_path{k + 1} AS (
            SELECT x.g, x.pos, p // 16 AS p, CASE WHEN kids IS NULL THEN path ELSE list_append(path, {{
                'l': array_to_string(kids[1:p % 16], ''), 'r': array_to_string(kids[p % 16 + 2:], '')}}) END AS path
            FROM {name}_path{k} x LEFT JOIN {name}{k + 1} q ON x.g IS NOT DISTINCT FROM q.g AND q.pos = p // 16
        )""")
    return ",\n".join(parts)


_LEVELS, _UPPER_LEVELS = 6, 4  # 16 million documents a source, 65 thousand sources


def _enc(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = f"""
    WITH {_CRC_TABLE}, d AS (
        SELECT doc_id, source, {_leaf("text")} AS leaf,
            CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(f"translate(text, {UPPER_LOWER})")} ELSE {_leaf("text")} END AS now
        FROM documents, crc_table
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM d
    ), {_tree("low", "SELECT source AS g, pos, size, leaf AS h FROM placed", _LEVELS)},
    tops AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM low_top),
    {_tree("high", "SELECT 0 AS g, pos, size, h FROM tops", _UPPER_LEVELS)},
    found AS (
        SELECT doc_id, leaf, now, t.h AS subroot, r.h AS root, list_concat(l.path, u.path) AS path
        FROM placed p JOIN low_path{_LEVELS} l ON p.source IS NOT DISTINCT FROM l.g AND p.pos = l.pos
        JOIN tops t ON t.source IS NOT DISTINCT FROM p.source
        JOIN high_path{_UPPER_LEVELS} u ON u.pos = t.pos CROSS JOIN high_top r
    ), folded AS (
        SELECT *, list_reduce(list_prepend(now, list_transform(path, lambda x: x.l || '|' || x.r)),
            lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
        FROM found
    )
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
        folded_root, folded_root = root AS verified
    FROM folded
"""


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), ''), {UPPER_LOWER})"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _address(url: str) -> str:
    kept = f"""array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1, 's'), '&'),
        lambda p: p <> '' AND NOT regexp_full_match(p, '(?s)({url_filters.TRACKING})(=.*)?')), '&')"""
    at = f"regexp_replace({_host(url)}, ':(80|443)?$', '')"
    return f"""CASE WHEN {at} <> '' THEN {at} || CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END
        || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"""


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _value(pattern: str, groups: int) -> str:
    return " || ".join(f"regexp_extract(tag, {_text(pattern)}, {g + 1})" for g in range(groups))


def _rule_of(key: str, source: str) -> str:
    return f"""SELECT {key}, first(r.host || r.path ORDER BY length(r.host || r.path) DESC) AS rule,
            first(r.verdict ORDER BY length(r.host || r.path) DESC) AS verdict
        FROM {source} s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
        GROUP BY {key}"""


OP13 = f"""
    WITH RECURSIVE rules(host, path, verdict) AS (
        VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ), seen AS (
        SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} AS address,
            row_number() OVER () AS row
        FROM pages
    ), tags AS (
        SELECT url, unnest(regexp_extract_all(html, {_text(url_filters._TAGS)}, 1)) AS tag FROM pages WHERE url IS NOT NULL
    ), hrefs AS (
        SELECT url, trim(replace(CASE
            WHEN lower(tag[1:5]) = '<link' AND regexp_matches(tag, {_text(url_filters._CANONICAL)}) THEN {_value(url_filters._HREF, 3)}
            WHEN lower(tag[1:5]) = '<meta' AND regexp_matches(tag, {_text(url_filters._REFRESH)})
                THEN regexp_extract({_value(url_filters._CONTENT, 2)}, {_text(url_filters._TARGET)}, 1)
            END, '&amp;', '&')) AS link
        FROM tags
    ), links AS (
        SELECT url AS a, CASE
            WHEN link = '' THEN NULL
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
            WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || link
            WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link
            WHEN starts_with(link, '?') OR starts_with(link, '#') THEN regexp_extract(url, '^([^?#]*)', 1, 's') || link
            ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's')
                || coalesce(nullif(regexp_extract({_path("url")}, '^(.*/)', 1, 's'), ''), '/') || link
            END AS b
        FROM hrefs WHERE link IS NOT NULL
    ), edges AS (
        SELECT a, b FROM (SELECT {_address("a")} AS a, {_address("b")} AS b FROM links) WHERE a <> b
    ), tied AS (
        SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT a, a FROM edges UNION SELECT b, b FROM edges
        UNION SELECT t.a, e.b FROM tied t JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON t.b = e.a
    ), nodes AS (
        SELECT DISTINCT a AS address, {_host("('any://' || a)")} AS host, {_path("('any://' || a)")} AS path FROM edges
        UNION SELECT DISTINCT b, {_host("('any://' || b)")}, {_path("('any://' || b)")} FROM edges
    ), ruled AS ({_rule_of("address", "nodes")}),
    spread AS (
        SELECT a AS address, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
        FROM tied JOIN ruled ON ruled.address = b GROUP BY a
    ), own AS ({_rule_of("row", "seen")})
    SELECT page_id, host, path, rule, coalesce(own.verdict, spread.verdict, 'allow') AS verdict
    FROM seen LEFT JOIN own USING (row) LEFT JOIN spread USING (address)
"""
