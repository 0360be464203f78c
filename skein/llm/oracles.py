"""SQL for DuckDB that gives the rows of the queries here, where SQL can express them: plain definitions, no method."""

from __future__ import annotations

from skein.llm import pii

#: Match lists by kind; SQL's engine has no look-behind, so the further kinds are found with the character before them.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) ELSE (CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) * 2) % 10 + CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) // 5 END)) % 10 = 0"
_TESTS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INT) <= 255))",
    "card": f"len({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"len({_DIGITS}) BETWEEN 10 AND 15",
}


def _kind(rank: int, kind: str) -> str:
    """Spans of one kind: what stands between matches has their lengths added up."""
    p = _BASE[kind]
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m, e - len(m) AS s, e FROM (
    SELECT doc_id, m, SUM(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, UNNEST(h) AS m, UNNEST(g[:len(h)]) AS g, UNNEST(range(len(h))) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{p}') AS h, regexp_split_to_array(text, '{p}') AS g FROM texts)))
  WHERE {_TESTS[kind]}"""


#: The base kinds only: op2_pii's own spans need look-behind.
PII_BASE = f"""
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_kind(i, k) for i, k in enumerate(pii.BASE))}),
listed AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS base,
  COUNT(*) FILTER (rank = 0) AS n_email, COUNT(*) FILTER (rank = 1) AS n_ip, COUNT(*) FILTER (rank = 2) AS n_card, COUNT(*) FILTER (rank = 3) AS n_phone
  FROM spans GROUP BY doc_id)
SELECT t.doc_id, COALESCE(n_email, 0) AS n_email, COALESCE(n_ip, 0) AS n_ip, COALESCE(n_card, 0) AS n_card, COALESCE(n_phone, 0) AS n_phone, sha256(COALESCE(base, '')) AS base_sha256
FROM texts t LEFT JOIN listed USING (doc_id)"""

#: The given pages hold their article in an article element, in h1 and p; SQL reads that, the query doesn't know it. A br is
#: white space inside a block.
HTML = r"""
WITH bodies AS (SELECT page_id, url, COALESCE(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS body FROM pages),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:h1|p)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS b FROM bodies),
plain AS (SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&eacute;', 'é'), '&mdash;', '—'), '&amp;', '&'),
  '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> '') AS b FROM blocks)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, len(array_to_string(b, chr(10))) AS n_chars FROM plain"""

#: Every window of every document that shares a shingle with an item, compared shingle by shingle.
LEAKS = r"""
WITH item_words AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
doc_words AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT item_id, len(w) - 4 AS m, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM item_words WHERE len(w) >= 5),
docs AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM doc_words WHERE len(w) >= 5),
item_s AS (SELECT item_id, m, x, COUNT(*) AS n FROM (SELECT item_id, m, UNNEST(s) AS x FROM items) GROUP BY ALL),
doc_s AS (SELECT doc_id, UNNEST(s) AS x, UNNEST(range(len(s))) AS pos, len(s) AS size FROM docs),
hits AS (SELECT doc_id, size, item_id, m, pos, x, n FROM doc_s JOIN item_s USING (x)),
pairs AS (SELECT DISTINCT doc_id, size, item_id, m FROM hits),
windows AS (SELECT doc_id, size, item_id, m, UNNEST(range(greatest(size - m, 0) + 1)) AS start FROM pairs),
common AS (SELECT doc_id, item_id, size, m, start, SUM(least(c, n)) AS common FROM (
  SELECT w.doc_id, w.item_id, w.size, w.m, w.start, h.x, h.n, COUNT(*) AS c FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.pos BETWEEN w.start AND w.start + w.m - 1 GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, CAST(common AS DOUBLE) / (least(size, m) + m - common) AS similarity FROM common)
SELECT doc_id, item_id, CAST(arg_max(start, similarity * 1000000000 - start) AS INT) AS start, MAX(similarity) AS similarity FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""

#: Sets of shingles as strings, links from shared ones, components by the least id that a walk reaches.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets),
classes AS (SELECT k, MIN(doc_id) AS class_id FROM sizes WHERE n > 0 GROUP BY k),
member AS (SELECT doc_id, n, COALESCE(class_id, doc_id) AS class_id FROM sizes LEFT JOIN classes USING (k)),
shingles AS (SELECT doc_id, UNNEST(s) AS x FROM sets SEMI JOIN classes ON sets.doc_id = classes.class_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, least(class_id, COALESCE((SELECT MIN(b) FROM reach WHERE a = class_id), class_id)) AS component_id, class_id,
  (SELECT COUNT(*) FROM links WHERE a = class_id) AS n_links
FROM member"""

#: op9_fingerprints without the digests themselves, which no SQL function here makes: edits, lengths, equality, classes.
EDITS = r"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text, trim(regexp_replace(lower(COALESCE(text, '')), '\s+', ' ', 'g')) AS canon FROM documents),
f AS (SELECT *, COALESCE(LEAD(text) OVER (ORDER BY doc_id), FIRST(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM t),
e AS (SELECT *, left(text, len(text) - len(text) // 4) || left(next, len(text) // 4) AS edited FROM f),
c AS (SELECT canon, MIN(doc_id) AS class_id, COUNT(*) AS class_size FROM t GROUP BY canon)
SELECT doc_id, len(text) AS n_chars, sha256(edited) AS edited_sha256,
  CASE WHEN trim(regexp_replace(lower(edited), '\s+', ' ', 'g')) = canon THEN 1.0 ELSE 0.0 END::DOUBLE AS near_edited,
  CASE WHEN trim(regexp_replace(lower(next), '\s+', ' ', 'g')) = canon THEN 1.0 ELSE 0.0 END::DOUBLE AS near_next, class_id, class_size
FROM e JOIN c USING (canon)"""

#: What any packing must keep: every byte of every document once, in bins that neither overflow nor repeat a source.
PACKED = """
SELECT doc_id, greatest(CAST(ceil(n / 8192.0) AS BIGINT), 1) AS pieces, CAST(n AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS faults
FROM (SELECT doc_id, strlen(COALESCE(text, '')) AS n FROM documents)"""

#: Every document scored for every item.
RANKED = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_docs, CAST(SUM(len(w)) AS BIGINT) AS n_words FROM w WHERE len(w) > 0),
asked AS (SELECT item_id, t, COUNT(*) AS times FROM (SELECT item_id, UNNEST(w) AS t FROM q) GROUP BY ALL),
tf AS (SELECT doc_id, n, t, COUNT(*) AS tf FROM (SELECT doc_id, len(w) AS n, UNNEST(w) AS t FROM w) GROUP BY ALL),
df AS (SELECT t, COUNT(*) AS df FROM tf GROUP BY t),
adds AS (SELECT doc_id, t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))) AS add
  FROM tf JOIN df USING (t), c WHERE t IN (SELECT t FROM asked)),
scored AS (SELECT item_id, doc_id, CAST(SUM(add * times) AS BIGINT) AS score FROM asked JOIN adds USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""

#: Texts grouped as they are.
EXACT = """
WITH n AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""

#: Whole numbers only: what op11_whitening says without components.
DEVIATIONS = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
e AS (SELECT vec_id, UNNEST(x) AS x, UNNEST(range(len(x))) AS i FROM good),
s AS (SELECT i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM e GROUP BY i)
SELECT vec_id, n, CAST(SUM((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM e JOIN s USING (i) GROUP BY vec_id, n"""
