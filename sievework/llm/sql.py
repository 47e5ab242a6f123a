"""Oracle SQL of the llm queries, where SQL can express them over whole tables."""

from __future__ import annotations

_WORD = r"[\p{L}\p{N}]+"

P1 = rf"""
WITH u AS (SELECT id, batch_no, source, external_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)(?:https?:)?//', '') AS bare FROM jobs),
v AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(?:80|443)$', '', 'g') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)(?:utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid|sessionid|trk)(?:=|$)'))) AS q,
  regexp_extract(external_id, '(\d+)\D*$', 1) AS num FROM u),
k AS (SELECT id, batch_no, 'u' || host || path || '?' || array_to_string(q, '&') AS key FROM v WHERE host <> '' UNION ALL SELECT id, batch_no, 'n' || source || '/' || CAST(CAST(num AS HUGEINT) AS VARCHAR) FROM v WHERE num <> ''),
e AS (SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.key = b.key AND a.batch_no < b.batch_no),
r AS (SELECT id, batch_no, regexp_extract_all(lower(coalesce(description, '')), '{_WORD}') AS w FROM jobs),
s AS (SELECT DISTINCT id, batch_no, hash(w[i], w[i + 1], w[i + 2]) AS g FROM r, unnest(range(1, len(w) - 1)) x(i) WHERE len(w) >= 30),
n AS (SELECT id, count(*) AS c FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.batch_no < b.batch_no GROUP BY 1, 2),
f AS (SELECT * FROM e UNION ALL SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE x / (na.c + nb.c - x) >= 0.6)
SELECT min(id_a) AS id_a, id_b FROM f GROUP BY id_b"""

P6 = rf"""
WITH r AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '{_WORD}') AS w FROM jobs WHERE len(regexp_extract_all(coalesce(description, ''), '{_WORD}')) >= 30),
s AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM r, unnest(range(1, len(w) - 1)) x(i)), n AS (SELECT id, count(*) AS c FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE x / (na.c + nb.c - x) >= 0.6"""

P9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) x(k) WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) x(k) WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p6_found": P6, "p9_found": P9}
