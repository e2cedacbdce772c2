"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op8_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256 FROM n JOIN g USING (body)
"""

# Windows and the texts' runs of as many words are compared as strings.
ORACLE["op11_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
g AS (
  SELECT row_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT g.row_id, g.k, v.n, v.item FROM g JOIN v USING (n, gram)),
c AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT row_id, k, n FROM h)) GROUP BY row_id),
t AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM h) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN t USING (row_id)
"""

# Written apart from the operator: all records of a URL in one window, no time spans, headers as plain columns.
ORACLE["op4_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, page_id * 60 AS t, 'day ' || CAST(page_id * 60 AS VARCHAR) AS modified,
    regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=x#part' AS other
  FROM pages),
v AS (SELECT *, '"' || md5(html) || '"' AS e1, '"' || md5(html || '<!-- changed -->') || '"' AS e2 FROM p),
r AS (
  SELECT page_id * 8 AS record_id, url, t - 1 AS ts, false AS full_, e1 AS etag, modified, NULL AS digest, CAST(NULL AS BIGINT) AS size FROM v
  UNION ALL SELECT page_id * 8 + 1, url, t, true, e1, modified, md5(html), strlen(html) FROM v
  UNION ALL SELECT page_id * 8 + 2, other, t + 36000, false, e1, modified, NULL, NULL FROM v
  UNION ALL SELECT page_id * 8 + 3, url, t + 72000, true, e2, modified, md5(html || '<!-- changed -->'), strlen(html || '<!-- changed -->')
    FROM v WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 8 + 4, other, t + 108000, false,
    CASE WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN e2 ELSE 'W/' || e1 END, modified, NULL, NULL FROM v),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS bare FROM r),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    list_aggregate(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)'))), 'string_agg', '&') AS query
  FROM b),
u AS (SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM k),
a AS (
  SELECT *, last_value(CASE WHEN full_ THEN {'id': record_id, 'etag': etag, 'modified': modified, 'digest': digest, 'size': size, 'date': ts} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY ts, full_, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM u),
o AS (
  SELECT *, CASE WHEN f IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM a WHERE NOT full_)
SELECT record_id, url_key, ts, outcome, CASE WHEN outcome = 'resolved' THEN f.id END AS response_id,
  CASE WHEN outcome = 'resolved' THEN f.digest END AS body_digest, CASE WHEN outcome = 'resolved' THEN f.size END AS body_length,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || CASE WHEN outcome = 'resolved' THEN CAST(f.size AS VARCHAR) ELSE '0' END || chr(10)
    || CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) ELSE '' END || 'date: ' || CAST(ts AS VARCHAR)
    || CASE WHEN etag IS NOT NULL THEN chr(10) || 'etag: ' || etag WHEN outcome = 'resolved' THEN chr(10) || 'etag: ' || f.etag ELSE '' END
    || chr(10) || 'last-modified: ' || modified AS headers
FROM o
"""
