"""SQL with the same results, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_SPACE_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, k, k + 4)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

_CONTAMINATED = f"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PLAIN_WORD}') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + 12) AS g, least(len(w), 13) AS width
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)
),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PLAIN_WORD}'), []) AS w FROM documents),
widths AS (SELECT DISTINCT width FROM g),
p AS (
  SELECT doc_id, width, k, list_slice(w, k, k + width - 1) AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d CROSS JOIN widths)
),
h AS (SELECT p.doc_id, p.k, p.width, g.item_id FROM p JOIN g ON p.g = g.g),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS word FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_REPEATS = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACE_WORD}'), []) AS w FROM documents),
p AS (SELECT doc_id, k, list_slice(w, k, k + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS word FROM p JOIN f USING (g) WHERE first < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word) AS text
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS word FROM d) ANTI JOIN gone USING (doc_id, word) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_URLS = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
r(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
f AS (
  SELECT page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

_THREADS = r"""
WITH RECURSIVE a AS (SELECT *, CASE WHEN turn % 3 = 0 THEN turn - 3 ELSE turn - 1 END AS up FROM conversations),
m AS (
  SELECT a.conv_id, a.turn, a.role, a.text AS own,
    coalesce('> > ' || replace(c.text, chr(10), chr(10) || '> > ') || chr(10), '')
      || coalesce('> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10), '') || a.text AS text
  FROM a LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.up LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = b.up
),
n AS (
  SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \t\r\x0B\x0C]+', ' ', 'g'))), lambda x: x <> '') AS w
  FROM conversations
),
s AS (SELECT conv_id, turn, len(w) AS n, chr(10) || array_to_string(w, chr(10)) || chr(10) AS body FROM n),
k AS (
  SELECT a.conv_id, a.turn, coalesce(any_value(f.n), 0) + coalesce(any_value(g.n), 0) AS n_quoted, max(o.turn) AS origin
  FROM a LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.up LEFT JOIN s f ON f.conv_id = a.conv_id AND f.turn = a.up
    LEFT JOIN s g ON g.conv_id = a.conv_id AND g.turn = b.up
    LEFT JOIN s o ON o.conv_id = a.conv_id AND o.turn < a.turn AND f.n > 0 AND contains(o.body, f.body) GROUP BY ALL
),
t AS (SELECT m.conv_id, m.turn, m.role, m.text, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_quoted, 0) AS n_linked, origin AS parent
  FROM m LEFT JOIN k USING (conv_id, turn)),
r(conv_id, turn, root) AS (
  SELECT conv_id, turn, turn FROM t WHERE parent IS NULL UNION ALL SELECT t.conv_id, t.turn, r.root FROM t JOIN r ON t.conv_id = r.conv_id AND t.parent = r.turn
)
SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY root, t.turn) AS position, t.turn, t.role, parent AS parent_turn, root AS root_turn,
  CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked,
  regexp_replace(array_to_string(list_filter(string_split(t.text, chr(10)), lambda x: NOT regexp_matches(x, '^([ \t]*>)+')), chr(10)), '^\s+|\s+$', '', 'g') AS text
FROM t JOIN r USING (conv_id, turn)
"""

_MIDDLES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM t
),
c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM w
),
p AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid,
    array_to_string(list_slice(w, b + 1, n), '') AS suf
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

_AUDIT = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_SPACE_WORD}') AS w, min(doc_id) OVER (PARTITION BY text) AS least_id FROM t),
g AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
),
m AS (
  SELECT part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least_id THEN 16 ELSE 0 END AS mask,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM w LEFT JOIN g USING (doc_id) GROUP BY ALL
),
l(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(list_slice(bits, 1, step - 1)), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
),
r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

ORACLE: dict[str, str] = {
    "op1_near_dedup": _NEAR,
    "op2_url_rules": _URLS,
    "op3_decontaminate": _CONTAMINATED,
    "op4_quote_links": _THREADS,
    "op7_substring_dedup": _REPEATS,
    "op12_fill_in_middle": _MIDDLES,
    "op13_filter_audit": _AUDIT,
}
