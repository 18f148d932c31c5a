"""DuckDB SQL with the results the registered queries must have, written independently of them."""

from __future__ import annotations

from corpusloom.checks.archive import BUDGETS, LISTING, RENDERED_IDS, TREES
from corpusloom.checks.queries import OWN_BUDGET, SMALL_BUDGET

# Challenge signatures with their labels, as they must be.
CHALLENGE_SIGNATURES = (
    ("sgcaptcha", "SiteGround CAPTCHA (SGCaptcha)"),
    ("/.well-known/sgcaptcha", "SiteGround CAPTCHA redirect"),
    ("cf-challenge", "Cloudflare challenge"),
    ("Just a moment", "Cloudflare JS challenge"),
    ("attention required", "Cloudflare Attention Required"),
    ("enable javascript", "JavaScript-required gate"),
    ("captcha", "Generic CAPTCHA"),
    ("hCaptcha", "hCaptcha challenge"),
    ("g-recaptcha", "Google reCAPTCHA"),
    ("Checking your browser", "Browser verification gate"),
    ("DDoS protection by", "DDoS protection interstitial"),
)

# Fixed value: the prompt, as it must be.
PROMPT = """\
You are generating an AI-friendly page summary in markdown.
Return markdown only. Do not add commentary outside markdown sections.
Do not invent details. If unknown, write "Not specified".
Please follow the structure below exactly, filling in each section based on the extracted content, making sure to translate everything to English.

Required structure:
# {title}

## TL;DR
- 2-4 bullets

## Key points
- 5-10 concrete bullets

## Useful context
- Content type: ...
- Location: ...
- Services/areas: ...
- Deliverables: ...
- Constraints/criteria: ...

## FAQ
- 5 to 8 Q/A pairs
Q: ...
A: ...

## Reference
- Source: {url}

Source title: {title}
Source URL: {url}

Extracted content to summarize:
{markdown}"""

_AS_OF = 1_704_067_200
_SPACE = r"[\s\x0B\x{85}\p{Z}]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def canon(u: str) -> str:
    """Canonical URL of an absolute URL without user info."""
    host = "regexp_replace(lower(r.a), CASE lower(r.s) WHEN 'http' THEN ':80$' ELSE ':443$' END, '')"
    escaped = r"replace(replace(regexp_replace(r.p, '%([0-9A-Fa-f]{2})', chr(1) || '\1', 'g'), '%', '%25'), chr(1), '%')"
    path = (
        f"array_to_string([CASE WHEN regexp_matches(c, '[!#$%&''()*+,\\-./0-9:;=?@A-Z\\[\\]_a-z~]') THEN c ELSE url_encode(c) END "
        f"FOR c IN string_split(rtrim({escaped}, '/'), '')], '')"
    )
    pairs = (
        "list_sort([{'f': upper(url_decode(split_part(t, '=', 1))), 'v': CASE WHEN contains(t, '=') THEN "
        "url_decode(substr(t, strpos(t, '=') + 1)) ELSE '' END, 'k': url_decode(split_part(t, '=', 1))} "
        "FOR t IN string_split(ltrim(r.q, '?'), '&') IF t <> '' AND NOT regexp_matches(t, '(?i)^(utm_|(fbclid|gclid|msclkid)(=|$))')])"
    )
    query = f"array_to_string([url_encode(x.k) || '=' || url_encode(x.v) FOR x IN {pairs}], '&')"
    parts = rf"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'a', 'p', 'q'])"
    return (
        f"[CASE WHEN r.s = '' THEN NULL ELSE lower(r.s) || '://' || {host} || "
        f"CASE WHEN rtrim(r.p, '/') = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END FOR r IN [{parts}]][1]"
    )


def unescape(x: str, closed: bool = False) -> str:
    """Character references the given pages use; a browser also reads ``&amp`` without the semicolon."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};{'' if closed else '?'}', '{char}', 'g')"
    return x


def title_regex(html: str) -> str:
    return unescape(trim(f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"), closed=True)


def title(html: str) -> str:
    words = unescape(f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return trim(f"regexp_replace({words}, '\\s+', ' ', 'g')")


def fold(x: str) -> str:
    return f"replace(upper(replace({x}, 'ß', chr(1))), chr(1), 'ß')"


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_FALLBACK = f"replace(trim({_PATH}, '/'), '-', ' ')"
_SLUG_RAW = (
    f"trim(regexp_replace(replace(regexp_replace(lower(trim({_PATH}, '/') || CASE WHEN contains(url, '?') THEN '_' || "
    f"split_part(url, '?', 2) ELSE '' END), '[^a-z0-9/_-]+', '_', 'g'), '/', '_'), '_+', '_', 'g'), '_')"
)
_SLUG = f"CASE WHEN {_SLUG_RAW} = '' THEN 'home' ELSE {_SLUG_RAW} END"
_FILE = f"({_SLUG}) || '_' || left(sha256(url), 8) || '.md'"

# Pages with canonical URL.
_C = f"c AS (SELECT page_id, {canon('url')} AS url, url AS raw, html FROM pages)"

# Pages with their site, their block in it and their URL shape, as the derived archive sees them.
_P = f"""p AS (
  SELECT *, block IS DISTINCT FROM lag(block) OVER s AS opens, block IS DISTINCT FROM lead(block) OVER s AS closes FROM (
  SELECT page_id, url AS raw, html, split_part(url, '/', 3) AS host, split_part(url, '/', 3) AS site, {canon('url')} AS url,
    floor(sqrt(row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1))::BIGINT AS block,
    CASE WHEN url LIKE '%.html' THEN 'html' WHEN url LIKE '%#top' THEN 'anchor' WHEN url LIKE '%utm_source=feed' THEN 'feed'
      WHEN url LIKE '%?page=2%' THEN 'paged' WHEN url LIKE '%/' THEN 'slash' ELSE 'plain' END AS shape
  FROM pages) WINDOW s AS (PARTITION BY site ORDER BY page_id))"""


def _budget(default: int) -> str:
    """Page budget of a ``site``."""
    own = " ".join(f"WHEN {i} THEN {budget}" for i, budget in enumerate(BUDGETS) if budget)
    return f"(CASE mod(length(site), {len(BUDGETS)}) {own} ELSE {default} END)"



_SIGNATURES = "[" + ", ".join(_quote(p) for p, _ in CHALLENGE_SIGNATURES) + "]"


def challenge(body: str) -> str:
    head = f"lower(left({body}, 4096))"
    cases = " ".join(f"WHEN contains({head}, {_quote(p.lower())}) THEN {_quote(label)}" for p, label in CHALLENGE_SIGNATURES)
    return f"CASE {cases} END"


def looks_like_html(body: str) -> str:
    return f"regexp_matches(left({body}, 4096), '(?i)<!doctype html|<html|<head|<body')"


_CAPS = f"""parts AS (
  SELECT site, host, block, min(page_id) AS first_id, 'https://' || host || '/part/' || block AS url, '<html><title>Part ' || block ||
    ' of ' || host || '</title><main><ul>' || string_agg('<li><a href="' || replace(raw, '&', '&amp;') || '">page</a>', '' ORDER BY page_id) ||
    '</ul></main></html>' AS body, sum(length('- [page](' || raw || ')')) AS chars
  FROM p GROUP BY site, host, block),
homes AS (
  SELECT site, host, min(first_id) AS first_id, '<html><title>Home of ' || host || '</title><main><ul>' ||
    string_agg('<li><a href="' || url || '">part</a>', '' ORDER BY block) || '</ul></main></html>' AS body,
    sum(length('- [part](' || url || ')')) AS chars
  FROM parts GROUP BY site, host),
caps AS (
  SELECT page_id AS capture_id, site, host, raw AS url,
    CASE shape WHEN 'feed' THEN 500 WHEN 'slash' THEN 404 ELSE 200 END AS status,
    CASE shape WHEN 'feed' THEN 'application/json' WHEN 'paged' THEN 'application/xhtml+xml' ELSE 'text/html' END AS kind,
    CASE shape WHEN 'html' THEN '<html><p>' || {_SIGNATURES}[page_id % {len(CHALLENGE_SIGNATURES)} + 1] || '</p>' || html
      WHEN 'anchor' THEN '<html><title>Gate</title><a href="/x">' || host || '</a></html>'
      WHEN 'feed' THEN '{{"error":"' || raw || '"}}' ELSE html END AS body, 'http' AS channel
  FROM p
  UNION ALL SELECT page_id + {RENDERED_IDS}, site, host, raw, 200, 'text/html',
    CASE WHEN host LIKE 'm.%' THEN '<p>Just a moment</p>' || html ELSE html END, 'rendered'
  FROM p WHERE host NOT LIKE 'www.%'
  UNION ALL SELECT -1 - first_id - 2 * {RENDERED_IDS}, site, host, url, 200, 'text/html', body, 'http' FROM parts
  UNION ALL SELECT -1 - first_id, site, host, 'https://' || host || '/', 200, 'text/html',
    CASE WHEN host LIKE 'm.%' THEN '<!-- cf-challenge -->' || body ELSE body END, 'http' FROM homes
  UNION ALL SELECT -1 - first_id - {RENDERED_IDS}, site, host, 'https://' || host || '/', 200, 'text/html', body, 'rendered' FROM homes),
judged AS (
  SELECT capture_id, site, {canon('url')} AS url, channel, body,
    CASE WHEN channel = 'http' THEN ((status BETWEEN 200 AND 299 AND regexp_matches(kind, 'html|xml')) OR {looks_like_html('body')})
      ELSE trim(body) <> '' END AS usable,
    {challenge('body')} AS label, length(body) < 600 AS thin
  FROM caps),
chosen AS (
  SELECT coalesce(h.site, r.site) AS site, coalesce(h.url, r.url) AS url,
    CASE WHEN h.usable AND h.label IS NULL AND NOT h.thin THEN 'http' WHEN r.usable THEN 'rendered' WHEN h.usable THEN 'http' END AS channel,
    CASE WHEN h.usable AND h.label IS NULL AND NOT h.thin THEN h.capture_id WHEN r.usable THEN r.capture_id
      WHEN h.usable THEN h.capture_id END AS capture_id,
    CASE WHEN NOT coalesce(h.usable, false) THEN 'failed' WHEN h.label IS NOT NULL THEN 'challenge' WHEN h.thin THEN 'thin' END AS fallback_reason,
    CASE WHEN h.usable THEN h.label END AS challenge,
    coalesce((NOT coalesce(h.usable, false) OR h.label IS NOT NULL OR h.thin) AND r.usable AND r.label IS NOT NULL, false) AS still_blocked
  FROM (SELECT * FROM judged WHERE channel = 'http' QUALIFY row_number() OVER (PARTITION BY site, lower(url) ORDER BY capture_id) = 1) h
  FULL JOIN (SELECT * FROM judged WHERE channel = 'rendered' QUALIFY row_number() OVER (PARTITION BY site, lower(url) ORDER BY capture_id) = 1) r
    ON h.site = r.site AND lower(h.url) = lower(r.url))"""

_PAGE_TITLE = f"CASE WHEN {title('body')} = '' THEN {_FALLBACK} WHEN channel = 'rendered' THEN {title_regex('body')} ELSE {title('body')} END"


def _listing(found: str, limit: str) -> str:
    """Distinct URLs of ``found(site, url, ord)`` with rank, cut at the budget."""
    return f"""SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY ord) AS rank FROM (
    SELECT site, url, min(ord) AS ord FROM ({found}) GROUP BY site, url) QUALIFY rank <= {limit}"""


def _sitemap(limit: str) -> str:
    return _listing(
        "SELECT site, url, CASE WHEN length(host) % 4 = 1 AND shape NOT IN ('html', 'slash') THEN 1000000000 ELSE 0 END + page_id AS ord "
        "FROM p WHERE length(host) % 4 < 2 OR (length(host) % 4 = 2 AND opens)",
        limit,
    )


def _feed(limit: str, listed: str = "closes") -> str:
    return _listing(
        f"SELECT site, url, page_id AS ord FROM p WHERE {listed} AND (length(host) % 3 <> 2 OR NOT contains(raw, '?'))", limit
    )


def _rest(limit: str) -> str:
    """CTEs ending in ``rest_kept`` and ``rest_state``."""
    return f"""entries AS (
  SELECT *, (row_number() OVER (PARTITION BY site, coll ORDER BY page_id) - 1) // {LISTING} + 1 AS page_no,
    count(*) OVER (PARTITION BY site, coll) AS n_all
  FROM (SELECT *, CASE WHEN contains(raw, '/en/') THEN 0 ELSE 1 END AS coll, length(host) % 4 AS turn FROM p WHERE length(host) % 7 <= 3)),
mapped AS (
  SELECT * FROM entries WHERE shape NOT IN ('html', 'slash') AND (turn = 0 OR (turn IN (1, 2) AND page_no <= 2) OR (turn = 3 AND page_no = 1))),
rest_n AS (
  SELECT e.site, count(*) FILTER (m.coll = 0) AS n0, count(*) FILTER (m.coll = 1) AS n1,
    bool_or(e.turn = 2 AND e.coll = 0 AND e.page_no = 3) AS stop0, bool_or(e.turn = 2 AND e.coll = 1 AND e.page_no = 3) AS stop1
  FROM entries e LEFT JOIN mapped m ON e.page_id = m.page_id GROUP BY e.site),
rest_state AS (
  SELECT site, least(n0, {limit}) AS pages_count,
    CASE WHEN stop0 AND n0 < {limit} THEN 0 ELSE least(n1, {limit} - least(n0, {limit})) END AS posts_count,
    (stop0 AND n0 < {limit}) OR (stop1 AND n1 < {limit} - least(n0, {limit})) AS disabled
  FROM rest_n),
rest_kept AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY coll, page_id) AS rank FROM (
    SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY site, coll ORDER BY page_id) AS place FROM mapped) m JOIN rest_state s USING (site)
    WHERE NOT s.disabled AND place <= CASE WHEN coll = 0 THEN pages_count ELSE posts_count END
    QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY coll, page_id) = 1)
  QUALIFY rank <= {limit})"""


def _of_tree(values) -> str:
    """A number of each site of links."""
    return "CASE n.site" + "".join(f" WHEN 's{k}.example.com' THEN {v}" for k, v in enumerate(values)) + " END"


def _bfs(limit: str, depth: int, own_depth: str = "") -> str:
    """CTEs ``lv0`` .. from ``roots(site, url)`` and ``edges(site, src, ord, dst)``; ``walk`` is their union."""
    own = f"< coalesce({own_depth}, 0)" if own_depth else f"< {depth}"
    ctes = ["lv0 AS MATERIALIZED (SELECT site, url, lower(url) AS k, 0 AS depth, 1 AS rank FROM roots)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT site, k, rank FROM lv{i}" for i in range(d))
        ctes.append(f"""seen{d} AS ({seen}),
lv{d} AS MATERIALIZED (
  SELECT site, dst AS url, k, {d} AS depth, used + row_number() OVER (PARTITION BY site ORDER BY parent, ord) AS rank FROM (
    SELECT e.site, e.dst, lower(e.dst) AS k, f.rank AS parent, e.ord FROM lv{d - 1} f JOIN edges e ON e.site = f.site AND e.src = f.k
    QUALIFY row_number() OVER (PARTITION BY e.site, lower(e.dst) ORDER BY f.rank, e.ord) = 1) n
  JOIN (SELECT site, max(rank) AS used FROM seen{d} GROUP BY site) USING (site)
  WHERE {d - 1} {own} AND NOT EXISTS (FROM seen{d} s WHERE s.site = n.site AND s.k = n.k)
  QUALIFY rank <= {limit})""")
    union = " UNION ALL ".join(f"SELECT site, url, depth, rank FROM lv{d}" for d in range(depth + 1))
    return ",\n".join([*ctes, f"walk AS ({union})"])


def _hrefs(html: str) -> str:
    return f"regexp_extract_all({html}, '<a href=\"([^\"]*)\"', 1)"


def _discovered(limit: str, allowed: str) -> str:
    """CTEs ending in ``found(site, url, discovery_method, depth, rank)``."""
    merge = f"""SELECT site, url, discovery_method, depth, row_number() OVER (PARTITION BY site ORDER BY pri, ord) AS rank FROM (
    SELECT * FROM (%s) WHERE {allowed}
    QUALIFY row_number() OVER (PARTITION BY site, lower(url) ORDER BY pri, ord) = 1) QUALIFY rank <= {limit}"""
    return f"""WITH {_P},
{_rest(limit)},
smap AS ({_sitemap(limit)}), feed AS ({_feed(limit)}),
listings AS (
  SELECT site, url, 'wordpress-rest' AS discovery_method, 0 AS depth, 0 AS pri, rank AS ord FROM rest_kept
  UNION ALL SELECT site, url, 'sitemap', 0, 1, rank FROM smap UNION ALL SELECT site, url, 'rss', 0, 2, rank FROM feed),
early AS ({merge % 'FROM listings'}),
roots AS (
  SELECT DISTINCT site, url FROM (SELECT site, 'https://' || host || '/' AS url FROM p)
  WHERE {allowed} AND site NOT IN (SELECT site FROM early GROUP BY site HAVING max(rank) >= {limit})),
bodies AS (
  SELECT p.site, lower(p.url) AS src, regexp_extract(p.url, '^[a-z]+://[^/]+', 0) AS base,
    CASE WHEN k.site IS NOT NULL THEN CASE WHEN k.shape IN ('plain', 'anchor') THEN {_hrefs('k.html')} ELSE [] END
      WHEN p.host LIKE 'www.%' AND p.shape = 'anchor' THEN ['/x'] WHEN p.host LIKE 'www.%' AND p.shape = 'feed' THEN []
      ELSE {_hrefs('p.html')} END AS hrefs
  FROM (FROM p QUALIFY row_number() OVER (PARTITION BY site, lower(url) ORDER BY page_id) = 1) p
  LEFT JOIN (FROM rest_kept QUALIFY row_number() OVER (PARTITION BY site, lower(url) ORDER BY rank) = 1) k
    ON k.site = p.site AND lower(k.url) = lower(p.url)),
edges AS MATERIALIZED (
  SELECT DISTINCT site, lower('https://' || host || '/') AS src, block AS ord, 'https://' || host || '/part/' || block AS dst FROM p
  UNION ALL SELECT site, lower('https://' || host || '/part/' || block), page_id, url FROM p
  UNION ALL SELECT site, src, ord, {canon("(base || " + unescape("href") + ")")} FROM (
    SELECT site, src, base, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS ord FROM bodies) WHERE href NOT LIKE '#%'),
{_bfs(limit, 3)},
found AS ({merge % "FROM listings UNION ALL SELECT site, url, 'crawl', depth, 3, rank FROM walk"})"""


_FETCH_TIME = f"strftime(make_timestamp(({_AS_OF} + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '0Z'"
_D = f"""d AS (
  SELECT doc_id, source AS site, 'https://' || source || '.example.org/doc/' || doc_id AS url, split_part(text, chr(10), 1) AS title,
    text, lang, {_FETCH_TIME} AS fetched,
    'doc_' || doc_id || '_' || left(sha256('https://' || source || '.example.org/doc/' || doc_id), 8) || '.md' AS file_name
  FROM documents)"""


def clean(x: str) -> str:
    crlf = f"replace({x}, chr(13) || chr(10), chr(10))"
    return trim(f"regexp_replace({crlf}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _front(title: str, content_hash: str) -> str:
    return (
        f"'---' || chr(10) || 'title: \"' || replace(replace({title}, '\\', '\\\\'), '\"', '\\\"') || '\"' || chr(10) || "
        f"'source_url: \"' || url || '\"' || chr(10) || 'fetched_at: \"' || fetched || '\"' || chr(10) || "
        f"'content_hash: \"' || {content_hash} || '\"' || chr(10) || 'generator: \"corpusloom\"' || chr(10) || '---'"
    )


_CHECKED = f"""{_D},
docs AS (SELECT *, sha256({clean('text')}) AS content_hash FROM d),
manifest AS (
  SELECT site, url, CASE lang WHEN 'en' THEN upper(content_hash) ELSE sha256(url) END AS content_hash,
    CASE site WHEN 'src1' THEN ' ' ELSE 'ai\\pages/' || file_name END AS relative_output_path,
    '2023-01-01T00:00:00.0000000Z' AS last_generated_at, CASE site WHEN 'src2' THEN '' ELSE 'Old ' || title END AS title
  FROM docs WHERE lang IN ('en', 'de')),
whole AS (FROM manifest UNION ALL SELECT site, url || '/gone', content_hash, relative_output_path, last_generated_at, title FROM manifest),
checked AS (SELECT *, lang = 'en' AND site <> 'src1' AS is_hit FROM docs),
answers AS (
  SELECT *, CASE WHEN lang = 'de' THEN '' WHEN lang = 'es' THEN NULL WHEN lang = 'fr' AND contains(site, '1') THEN NULL
    ELSE {trim("'# ' || title || chr(10) || chr(10) || url")} END AS summary
  FROM checked WHERE NOT is_hit)"""


def _prompt() -> str:
    sql = _quote(PROMPT)
    for name, column in (("title", "title"), ("url", "url"), ("markdown", "text")):
        sql = sql.replace("{" + name + "}", f"' || {column} || '")
    return sql


def _lines(entries: str, header: list[str], extra: str = "") -> str:
    """Numbered lines from ``entries(site, title, rank, line)`` and a header per ``sites(site, host)`` row."""
    fixed = " UNION ALL ".join(f"SELECT site, 0 AS section, '' AS fold, {i} AS rank, {line} AS line FROM sites" for i, line in enumerate(header))
    return f"""lines AS (
  {fixed}
  UNION ALL SELECT site, 1, {fold('title')}, rank, line FROM ({entries}){extra}),
numbered AS (SELECT site, section, row_number() OVER (PARTITION BY site ORDER BY section, fold, rank) AS ord, line FROM lines)"""


_INDEX_HEADER = [
    "'# llms.txt for ' || host",
    "''",
    "'Site root: https://' || host || '/'",
    "'Short description: AI-friendly markdown summaries generated by corpusloom.'",
    "''",
    "'## Index'",
]
_DOC_SITES = "sites AS (SELECT site, site || '.example.org' AS host, count(*) AS n FROM d GROUP BY site)"
_DOC_ENTRIES = "SELECT site, title, doc_id AS rank, '- ' || title || ': https://' || site || '.example.org/ai/pages/' || file_name AS line FROM d"
_BLOCK = (
    "'---' || chr(10) || 'Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Content Hash: ' || sha256(text) || chr(10) || "
    f"'Relative Output Path: ai/pages/' || file_name || chr(10) || chr(10) || {trim('text')} || chr(10)"
)
_FULL_HEADER = [
    "'# llms-full.txt for ' || host",
    "''",
    "'Site root: https://' || host || '/'",
    "'Description: Full AI-friendly corpus generated by corpusloom.'",
    "'Generated at (UTC): 2024-01-01T00:00:00.0000000Z'",
    "'Pages included: ' || n",
    "''",
    "'## Index'",
]
_FULL_EXTRA = (
    "\n  UNION ALL SELECT site, 2, '', unnest([0, 1, 2]), unnest(['', '## Pages', '']) FROM sites"
    f"\n  UNION ALL SELECT site, 3, {fold('title')}, doc_id, {_BLOCK} FROM d"
)

def _escaped_text(x: str) -> str:
    plain = trim(unescape(rf"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')"))
    return f"replace(replace({plain}, '*', '\\*'), '_', '\\_')"


# Markdown of an article as the given pages write it: a heading, then paragraphs, bold from the first open <b> on.
_MARKDOWN = f"""m AS (
  SELECT page_id, '# ' || {_escaped_text("parts[1]")} || coalesce(string_agg(chr(10) || chr(10) || CASE WHEN bold THEN '**' || t || '**' ELSE t END, '' ORDER BY i), '') AS markdown
  FROM (
    SELECT page_id, parts, i, {_escaped_text("parts[i]")} AS t, bool_or(contains(parts[i], '<b>')) OVER (PARTITION BY page_id ORDER BY i) AS bold
    FROM (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS i
      FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS parts FROM pages)))
  WHERE t <> '' GROUP BY page_id, parts)"""

_ALLOWED_ALL = "true"
_ALLOWED_SOME = "NOT contains(lower(url), '/de/') AND NOT contains(lower(url), 'utm_source')"

_SANITIZED = f"regexp_replace(regexp_replace({trim('i.i.html')}, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g')"
_SHELLS = f"""{_discovered(_budget(200), _ALLOWED_ALL)}, {_CAPS},
item AS (SELECT site, lower(url) AS k, arg_min(struct_pack(page_id := page_id, shape := shape, html := html, host := host), rank) AS i FROM rest_kept GROUP BY 1, 2),
cap AS (SELECT c.site, lower(c.url) AS k, c.channel, c.capture_id, j.body FROM chosen c JOIN judged j USING (capture_id)),
shells AS (
  SELECT f.site, f.url, f.rank, i.i, cap.capture_id,
    CASE WHEN i.k IS NULL THEN cap.body ELSE '<article>' || CASE i.i.shape WHEN 'feed' THEN {title_regex('i.i.html')}
      WHEN 'paged' THEN '<p>caf&#233; &lt;q&gt; &amp; ' || i.i.host || '</p>' ELSE {_SANITIZED} END || '</article>' END AS html,
    CASE WHEN i.k IS NULL THEN cap.body WHEN i.i.shape = 'anchor' THEN '' ELSE i.i.html END AS body,
    CASE WHEN i.k IS NULL THEN cap.channel ELSE 'rendered' END AS channel
  FROM found f LEFT JOIN item i ON i.site = f.site AND i.k = lower(f.url) LEFT JOIN cap ON cap.site = f.site AND cap.k = lower(f.url)
  WHERE i.k IS NOT NULL OR cap.body IS NOT NULL)"""
# Markdown length of every discovered page: of a REST item, a home or part page's link list, a gate page, or an article.
_BUILT = f"""{_SHELLS}, {_MARKDOWN},
built AS (
  SELECT f.site, f.url, f.rank, s.body, s.channel,
    CASE WHEN s.site IS NULL THEN NULL
      WHEN s.i.shape = 'feed' THEN length({_escaped_text(title_regex('s.i.html'))})
      WHEN s.i.shape = 'paged' THEN length('café <q> & ' || s.i.host)
      WHEN s.i IS NOT NULL THEN 1000 + length(a.markdown)
      WHEN s.capture_id < 0 THEN coalesce(q.chars, h.chars)
      WHEN contains(s.body, '<title>Gate</title>') THEN length('[' || split_part(f.url, '/', 3) || '](/x)')
      ELSE length(b.markdown) END AS chars
  FROM found f LEFT JOIN shells s ON s.site = f.site AND s.url = f.url
  LEFT JOIN parts q ON q.site = f.site AND q.url = f.url LEFT JOIN homes h ON h.site = f.site
  LEFT JOIN m a ON a.page_id = s.i.page_id LEFT JOIN m b ON b.page_id = s.capture_id % {RENDERED_IDS})"""
# The same articles with a paragraph added.
_EDITED = """e AS (
  SELECT page_id, markdown || chr(10) || chr(10) || CASE WHEN regexp_matches(html, '(?s)<article>.*<b>.*</article>') THEN '**Edited**' ELSE 'Edited' END AS edited
  FROM m JOIN pages USING (page_id))"""

# The newest version of every page, the renamed ones last, and the first page by URL of each file.
_CLASHES = f"""{_C}, {_MARKDOWN}, {_EDITED}, v AS (
    SELECT split_part(url, '/', 3) AS site, url, html, page_id, CASE WHEN contains(raw, '?page=2') THEN 2 ELSE 1 END AS day FROM c UNION ALL
    SELECT split_part(url, '/', 3), url, replace(html, '<title>', '<title>Zed '), page_id, 3 FROM c WHERE raw LIKE '%.html'),
  newest AS (FROM v QUALIFY row_number() OVER (PARTITION BY url ORDER BY day DESC, page_id) = 1),
  named AS (SELECT site, url, split_part({title('html')}, ' ', 1) || '.md' AS file_name, CASE WHEN day = 3 THEN edited ELSE markdown END AS body
    FROM newest LEFT JOIN m USING (page_id) LEFT JOIN e USING (page_id)),
  stood AS (SELECT *, coalesce(length(body), 0) < 50 AS short,
    coalesce(length(body), 0) >= 50 AND url = min(CASE WHEN length(body) >= 50 THEN url END) OVER (PARTITION BY site, file_name) AS owns FROM named)"""

ORACLE: dict[str, str] = {
    "url_canonical": f"WITH {_C} SELECT page_id, url FROM c",
    "url_names": f"""WITH {_C} SELECT page_id, {_SLUG} AS slug, {_FILE} AS file_name, split_part(url, '/', 3) AS safe_host,
        split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS authority, {_FALLBACK} AS fallback_title, url LIKE 'http%' AS is_http FROM c""",
    "url_filtered": f"""WITH {_C} SELECT page_id, url FROM c
        WHERE (url ILIKE '%/en/%' OR contains(lower(url), 'blog.') OR url ILIKE '%/fr/%page=2%')
        AND NOT contains(lower(url), '.html') AND NOT url ILIKE '%://m.%'""",
    "url_filtered_by_site": f"""WITH {_C} SELECT page_id, url FROM (SELECT *, split_part(url, '/', 3) AS host FROM c)
        WHERE (host NOT LIKE 'www.%' OR url ILIKE '%/en/%')
        AND NOT (host LIKE 'm.%' AND (contains(url, 'page=2') OR url LIKE '%' || host || '/de%'))""",
    "url_filtered_by_list": f"""WITH {_C}, h AS (SELECT *, split_part(url, '/', 3) AS site FROM c),
        x AS (SELECT DISTINCT site, lower(regexp_extract(url, '^[a-z]+://[^/]+(.*)\\.html$', 1)) AS pattern FROM h WHERE url LIKE '%.html')
        SELECT page_id, url FROM h WHERE (site NOT LIKE 'www.%' OR url ILIKE '%/en/%' OR contains(url, '?'))
        AND NOT EXISTS (FROM x WHERE x.site = h.site AND x.pattern <> '' AND contains(lower(h.url), x.pattern))""",
    "links": f"""WITH {_C}, h AS (
          SELECT page_id, generate_subscripts(hrefs, 1) AS pos, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS base, unnest(hrefs) AS href
          FROM (SELECT page_id, url, {_hrefs('html')} AS hrefs FROM c)),
        l AS (SELECT page_id, pos, {canon("(base || " + unescape("href") + ")")} AS link FROM h WHERE href NOT LIKE '#%' AND trim(href) <> '')
        SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1)::INTEGER AS link_ord, link FROM l GROUP BY page_id, link""",
    "titles": f"""WITH {_C} SELECT page_id, {title('html')} AS title,
        {title_regex('html')} AS title_regex FROM c""",
    "sniffed": f"""WITH {_P}, {_CAPS} SELECT capture_id, {looks_like_html('body')} AS looks_like_html, {challenge('body')} AS challenge,
        {challenge('body')} IS NOT NULL AS is_challenge, length(body) < 600 AS is_too_thin FROM caps""",
    "page_shells": f"""WITH {_P}, {_CAPS}, ok AS (
          SELECT capture_id, site, {canon('url')} AS url, body, channel FROM caps
          WHERE (status BETWEEN 200 AND 299 AND regexp_matches(kind, 'html|xml')) OR {looks_like_html('body')})
        SELECT capture_id, site, url, {_PAGE_TITLE} AS title, length(body) AS chars FROM ok""",
    "triage": f"WITH {_P}, {_CAPS} SELECT * FROM chosen",
    "fallback_pages": f"""WITH {_P}, {_CAPS}, used AS (SELECT c.site, c.url, c.channel, j.body FROM chosen c JOIN judged j USING (capture_id))
        SELECT site, url, {_PAGE_TITLE} AS title, sha256(body) AS html_hash FROM used""",
    "protection": f"""WITH {_P} SELECT CASE WHEN host LIKE 'm.%' THEN 'Cloudflare challenge' ELSE 'none' END AS label,
        count(DISTINCT site) AS sites FROM p GROUP BY 1""",
    "sitemap_urls": f"""WITH {_P} SELECT site, url, 'sitemap' AS discovery_method, 0 AS depth, rank FROM ({_sitemap(_budget(200))})""",
    "rendered_sitemaps": f"""WITH {_P} SELECT site, url, 'sitemap' AS discovery_method, 0 AS depth, rank FROM ({_sitemap(_budget(200))})""",
    "feed_urls": f"""WITH {_P} SELECT site, url, 'rss' AS discovery_method, 0 AS depth, rank FROM ({_feed(_budget(200), "true")})""",
    "rest_probe": f"""WITH {_P} SELECT DISTINCT site, length(host) % 7 <= 3 AS available,
        CASE length(host) % 7 WHEN 4 THEN 'Cloudflare JS challenge' WHEN 5 THEN 'HTTP 401 from https://' || host || '/wp-json/'
          WHEN 6 THEN 'WP REST blocked by site protection: Cloudflare JS challenge' END AS reason,
        length(host) % 7 IN (4, 6) AS blocked_by_challenge FROM p""",
    "rest_items": f"""WITH {_P}, {_rest(_budget(200))}
        SELECT site, rank, url, CASE WHEN shape = 'anchor' THEN {_FALLBACK} ELSE {trim(title_regex('html'))} END AS title,
          sha256(CASE shape WHEN 'feed' THEN {title_regex('html')} WHEN 'paged' THEN '<p>caf&#233; &lt;q&gt; &amp; ' || host || '</p>'
            ELSE regexp_replace(regexp_replace({trim('html')}, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g') END) AS html_hash,
          CASE WHEN shape = 'plain' THEN 1769940000 ELSE {_AS_OF} END AS modified FROM rest_kept""",
    "rest_status": f"""WITH {_P}, {_rest(_budget(200))} SELECT site, pages_count, posts_count, disabled,
        CASE WHEN disabled THEN 403 END AS refused_status FROM rest_state""",
    "discovered": f"{_discovered(_budget(200), _ALLOWED_ALL)} SELECT site, url, discovery_method, depth, rank FROM found",
    "discovered_small_budget": f"{_discovered(_budget(SMALL_BUDGET), _ALLOWED_SOME)} SELECT site, url, discovery_method, depth, rank FROM found",
    "dry_run": f"{_discovered(_budget(200), _ALLOWED_ALL)} SELECT site, rank, url FROM found",
    "rest_override": f"""{_SHELLS} SELECT site, url, rank, {_PAGE_TITLE} AS title, sha256(html) AS html_hash FROM shells""",
    "crawl": f"""WITH t AS (
          SELECT 's' || (page_id % {len(TREES)}) || '.example.com' AS site, page_id // {len(TREES)} AS n, html FROM pages),
        roots AS (SELECT DISTINCT site, 'https://' || site || '/' AS url FROM t),
        edges AS MATERIALIZED (
          SELECT site, src, ord, {canon("('https://' || site || " + unescape("href") + ")")} AS dst FROM (
            SELECT site, 'https://' || site || CASE n WHEN 0 THEN '/' ELSE '/p/' || n END AS src, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS ord
            FROM (SELECT *, {_hrefs('html')} || ['/', '/p/' || (4 * n + 1), '/P/' || (4 * n + 2), '/p/' || (4 * n + 3), '/P/' || (4 * n + 4)] AS hrefs FROM t))
          WHERE href NOT LIKE '#%'),
        {_bfs(_of_tree(b for b, _ in TREES), max(d for _, d in TREES), _of_tree(d for _, d in TREES))} SELECT site, url, depth, rank FROM walk""",
    "distinct_urls": f"WITH {_C} SELECT split_part(url, '/', 3) AS site, url, min(page_id) AS ordinal FROM c GROUP BY 1, 2",
    "budgeted": f"""WITH {_C} SELECT site, url, ordinal, row_number() OVER (PARTITION BY site ORDER BY ordinal) AS rank FROM (
        SELECT split_part(url, '/', 3) AS site, url, min(page_id) AS ordinal FROM c GROUP BY 1, 2) QUALIFY rank <= CASE WHEN length(site) % 2 = 0 THEN {OWN_BUDGET} ELSE {SMALL_BUDGET} END""",
    "extract": f"""WITH {_MARKDOWN} SELECT page_id, CASE WHEN length(markdown) < 50 THEN 'ExtractionSkipped' ELSE 'Success' END AS outcome,
        length(markdown) < 50 AS is_skipped, CASE WHEN length(markdown) < 50 THEN 'Extracted markdown too short (<50 chars)' END AS skip_reason,
        length(markdown) AS chars, sha256(markdown) AS content_hash FROM m""",
    "extract_text": rf"""SELECT page_id, sha256({trim("regexp_replace(regexp_replace(" + unescape("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')") + r", '[*#\\_]', '', 'g'), '\s+', ' ', 'g')")}) AS text_hash FROM pages""",
    "skip_rule": f"""SELECT lang, CASE WHEN length({clean("text")}) < 50 THEN 'Extracted markdown too short (<50 chars)' ELSE 'kept' END AS reason,
        count(*) AS pages FROM documents GROUP BY 1, 2""",
    "clean_text": f"""SELECT doc_id, sha256(regexp_replace({trim('text')}, '\\n+', chr(10) || chr(10), 'g')) AS clean_hash,
        sha256('\\"\\\\' || replace(replace(text, '\\', '\\\\'), '"', '\\"')) AS yaml_hash,
        sha256('<p>' || array_to_string([CASE WHEN unicode(c) BETWEEN 160 AND 255 THEN '&#' || unicode(c) || ';' WHEN c = '&' THEN '&amp;'
          WHEN c = '<' THEN '&lt;' WHEN c = '>' THEN '&gt;' WHEN c = '"' THEN '&quot;' WHEN c = '''' THEN '&#39;' ELSE c END
          FOR c IN string_split(text, '')], '') || '</p>') AS encoded_hash FROM documents""",
    "conversation_text": "SELECT conv_id, turn, sha256('<article>' || text || '<script>open</article>') AS hash FROM conversations",
    "frontmatter": f"""WITH {_D} SELECT doc_id, sha256({_front("title || ' \"' || chr(92)", "sha256(text)")} || chr(10) || text || chr(10)) AS file_hash,
        sha256({trim('text')}) AS body_hash, sha256({trim("'---' || chr(10) || text")}) AS unclosed_hash FROM d""",
    "cache_split": f"WITH {_CHECKED} SELECT site, url, is_hit FROM checked",
    "cached_bodies": f"""WITH {_CHECKED} SELECT site, url, CASE site WHEN 'src2' THEN title ELSE 'Old ' || title END AS title,
        CASE site WHEN 'src3' THEN '' ELSE 'Summary of ' || url END AS markdown, upper(content_hash) AS content_hash,
        file_name, 'ai/pages/' || file_name AS relative_output_path FROM checked WHERE is_hit""",
    "counters": f"""WITH {_CHECKED}, res AS (
          SELECT c.site, CASE WHEN length(c.title) < 12 THEN 'gone' WHEN length({clean('c.title')}) < 50 AND length(c.title) < 20 THEN 'short'
            WHEN is_hit THEN 'hit' WHEN a.summary IS NOT NULL THEN 'done' ELSE 'error' END AS r
          FROM checked c LEFT JOIN (SELECT url, summary FROM answers) a USING (url))
        SELECT site, count(*) AS discovered, count(*) FILTER (r = 'done') AS processed, count(*) FILTER (r IN ('short', 'hit')) AS skipped,
          count(*) FILTER (r IN ('gone', 'error')) AS failed, count(*) FILTER (r = 'hit') AS cached FROM res GROUP BY site""",
    "manifest_upsert": f"""WITH {_CHECKED}, fresh AS (
          SELECT site, url, content_hash, 'ai/pages/' || file_name AS relative_output_path, '2024-01-01 00:00:00' AS last_generated_at, title
          FROM answers WHERE summary IS NOT NULL)
        FROM whole WHERE url NOT IN (SELECT url FROM fresh) UNION ALL FROM fresh""",
    "manifest_json": f"WITH {_CHECKED} FROM whole",
    "requests": f"""WITH {_CHECKED} SELECT site, url, content_hash, sha256({_prompt()}) AS prompt_hash, 'summarizer' AS model,
        'false' AS stream, 0.2::DOUBLE AS temperature FROM checked WHERE NOT is_hit""",
    "responses": f"""WITH {_CHECKED} SELECT site, url, title, summary AS markdown, file_name, 'ai/pages/' || file_name AS relative_output_path FROM answers""",
    "injected_summaries": f"""WITH {_D} SELECT site, url, CASE WHEN contains(text, '.') THEN
        {trim("title || ': ' || text")} END AS markdown FROM d""",
    "index": f"""WITH {_C}, named AS (
          SELECT split_part(url, '/', 3) AS site, url, {title('html')} AS title, {_FILE} AS file_name, page_id FROM c),
        firsts AS (FROM named QUALIFY row_number() OVER (PARTITION BY site, lower(file_name) ORDER BY page_id) = 1),
        sites AS (SELECT DISTINCT site, site AS host FROM named),
        {_lines("SELECT site, title, page_id AS rank, '- ' || title || ': https://' || site || '/ai/pages/' || file_name AS line FROM firsts", _INDEX_HEADER)}
        SELECT site, section, ord, line FROM numbered""",
    "full_corpus": f"""WITH {_D}, {_DOC_SITES}, {_lines(_DOC_ENTRIES, _FULL_HEADER, _FULL_EXTRA)}
        SELECT site, section, ord, sha256(line) AS line_hash FROM numbered""",
    "page_files": f"""WITH {_D} SELECT site || '/ai/pages/' || file_name AS path,
        sha256({_front('title', 'sha256(text)')} || chr(10) || {trim('text')} || chr(10)) AS content_hash FROM d""",
    "published_files": f"""WITH {_D}, {_DOC_SITES}, {_lines(_DOC_ENTRIES, _INDEX_HEADER)}
        SELECT site || '/llms.txt' || CASE part WHEN 0 THEN '' ELSE '.part-' || lpad(part::VARCHAR, 5, '0') END AS path,
          string_agg(line, chr(10) ORDER BY ord) || chr(10) AS content FROM (SELECT *, (ord - 1) // 10 AS part FROM numbered) GROUP BY site, part""",
    "published_text": f"WITH {_D}, {_DOC_SITES}, {_lines(_DOC_ENTRIES, _INDEX_HEADER)} SELECT site, line FROM numbered",
    "published_documents": f"""WITH {_D}, t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'Edited' ELSE text END AS body FROM d)
        SELECT site || '/ai/pages/' || file_name AS path, sha256({_front('title', 'sha256(text)')} || chr(10) || {trim('body')} || chr(10)) AS content_hash FROM t""",
    "published_deltas": f"""WITH {_D}, t AS (SELECT *, text || CASE WHEN doc_id % 50 = 0 THEN chr(10) || 'Edited 50' WHEN doc_id % 7 = 0 THEN chr(10) || 'Edited 7'
            WHEN doc_id % 3 = 0 THEN chr(10) || 'Edited 3' ELSE '' END AS body FROM d)
        SELECT site || '/ai/pages/' || file_name AS path, sha256({_front('title', 'sha256(text)')} || chr(10) || {trim('body')} || chr(10)) AS content_hash FROM t""",
    "dedupe_names": f"""WITH {_D}, n AS (
          SELECT site, url, CASE WHEN doc_id % 2 = 0 THEN {fold('title')} ELSE lower(title) END || '.md' AS file_name, doc_id AS rank FROM d)
        FROM n QUALIFY row_number() OVER (PARTITION BY site, lower(file_name) ORDER BY rank) = 1""",
    "collisions": f"""WITH {_D}, n AS (SELECT site, url, title || '.md' AS file_name, doc_id, title FROM d),
        old AS (SELECT site, file_name, min(url || '/old') AS url FROM n WHERE title LIKE 'A%' GROUP BY 1, 2),
        claims AS (SELECT n.*, coalesce(old.url, first_value(n.url) OVER (PARTITION BY n.site, n.file_name ORDER BY n.doc_id)) AS claimed_by
          FROM n LEFT JOIN old ON old.site = n.site AND old.file_name = n.file_name)
        SELECT site, url, file_name, claimed_by, claimed_by <> url AS collides FROM claims""",
    "incremental_stream": f"""WITH {_C}, {_MARKDOWN}, {_EDITED}, v AS (
          SELECT split_part(url, '/', 3) AS site, url, html, page_id, raw,
            CASE WHEN raw LIKE '%.html' THEN 3 WHEN contains(raw, '?page=2') THEN 2 ELSE 1 END AS day FROM c),
        newest AS (FROM v QUALIFY row_number() OVER (PARTITION BY url ORDER BY day DESC, page_id) = 1)
        SELECT site, url, {title('html')} AS title, 'ai/pages/' || {_FILE} AS relative_output_path, true AS same_as_batch
        FROM newest JOIN m USING (page_id) JOIN e USING (page_id) WHERE length(CASE WHEN day = 3 THEN edited ELSE markdown END) >= 50""",
    "stream_owners": f"""WITH {_CLASHES}
        SELECT site, url, site || '/ai/pages/' || file_name AS path, sha256({trim('body')}) AS body_hash FROM stood WHERE owns""",
    "stream_counters": f"""WITH {_CLASHES}
        SELECT site, count(*) AS discovered, count(*) FILTER (owns) AS processed, count(*) FILTER (short) AS skipped,
          count(*) FILTER (NOT owns AND NOT short) AS failed, 0 AS cached FROM stood GROUP BY site""",
    "change_stream": f"""WITH {_C}, {_MARKDOWN}, {_EDITED}, v AS (
          SELECT url, page_id AS capture_id, markdown, 1 AS day FROM c JOIN m USING (page_id) UNION ALL
          SELECT url, page_id + {RENDERED_IDS}, CASE WHEN contains(url, '//blog.') THEN edited ELSE markdown END, 2 FROM c JOIN m USING (page_id) JOIN e USING (page_id))
        SELECT split_part(url, '/', 3) AS site, url, capture_id FROM (FROM v WHERE length(markdown) >= 50)
        QUALIFY markdown IS DISTINCT FROM lag(markdown) OVER (PARTITION BY url ORDER BY day, capture_id)""",
    "corpus_counters": f"""{_BUILT}
        SELECT site, count(*) AS discovered, count(*) FILTER (chars >= 50) AS processed, count(*) FILTER (chars < 50) AS skipped,
          count(*) FILTER (chars IS NULL) AS failed, 0 AS cached FROM built GROUP BY site""",
    "corpus_index": f"""{_BUILT}, named AS (SELECT site, url, rank, {_PAGE_TITLE} AS title, {_FILE} AS file_name FROM built WHERE chars >= 50),
        sites AS (SELECT DISTINCT site, host FROM p),
        {_lines("SELECT n.site, title, rank, '- ' || title || ': https://' || host || '/ai/pages/' || file_name AS line FROM named n JOIN sites USING (site)", _INDEX_HEADER)}
        SELECT site, section, ord, line FROM numbered""",
}
