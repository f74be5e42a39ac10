"""SQL for an independent engine, one statement for each query that SQL can express."""

from __future__ import annotations

from voxlake.llm.sharding import SHARDS, SLOTS, lookup_table, shard_names
from voxlake.llm.url_filter import LISTED_LABELS, RULES

SQL: dict[str, str] = {}

_OWNERS = ",".join(map(str, lookup_table(shard_names(SHARDS), SLOTS)))
SQL["op2_sharding"] = f"""WITH s AS (SELECT doc_id, CAST(CAST('0x' || LEFT(MD5(COALESCE(CAST(doc_id AS VARCHAR), '')), 12) AS UBIGINT) % {SLOTS} AS INT) slot FROM documents)
SELECT doc_id, slot, CAST([{_OWNERS}][slot + 1] AS INT) shard FROM s"""

_LOWER = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"REGEXP_EXTRACT_ALL({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op3_decontamination"] = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark WHERE text IS NOT NULL),
 iw AS (SELECT item, LEAST(LEN(w), 10) n, UNNEST(LIST_TRANSFORM(range(1, LEN(w) - LEAST(LEN(w), 10) + 2), lambda k: ARRAY_TO_STRING(w[k : k + LEAST(LEN(w), 10) - 1], ' '))) win FROM i WHERE LEN(w) > 0),
 sizes AS (SELECT DISTINCT n FROM iw), d AS (SELECT doc_id, {_WORDS} w FROM documents),
 dw AS (SELECT doc_id, n, UNNEST(LIST_TRANSFORM(range(1, LEN(w) - n + 2), lambda k: {{'k': k, 'win': ARRAY_TO_STRING(w[k : k + n - 1], ' ')}})) x FROM d, sizes WHERE LEN(w) >= n),
 hit AS (SELECT doc_id, dw.n, x.k k, item FROM dw JOIN iw ON iw.win = x.win AND iw.n = dw.n),
 words AS (SELECT doc_id, COUNT(*) n_hit FROM (SELECT DISTINCT doc_id, UNNEST(range(k, k + n)) p FROM hit) GROUP BY 1),
 items AS (SELECT doc_id, COUNT(*) n_items, SHA256(STRING_AGG(item, ',' ORDER BY item)) h FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(LEN(w) AS BIGINT) n_words, COALESCE(n_hit, 0) n_hit, COALESCE(n_items, 0) n_items, COALESCE(h, SHA256('')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_HOST = r"LOWER(REGEXP_EXTRACT(COALESCE(url, ''), '^(?s:.*?)://([^/?#]*)', 1))"
_PATH = r"REGEXP_EXTRACT(COALESCE(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_QUERY = r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_EXTRACT(COALESCE(url, ''), '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^=&]*|ref)(=[^&]*)?', '', 'g'), '^&', '')"
_CASES = " ".join(f"WHEN (host = '{h}' OR ENDS_WITH(host, '.{h}')) AND STARTS_WITH(path, '{p}') THEN {{'rule': '{h}{p}', 'v': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_LISTED = "(^|\\.)(" + "|".join(LISTED_LABELS) + ")(\\.|$)"
SQL["op4_url_filter"] = rf"""WITH p AS (SELECT page_id, {_HOST} host, {_PATH} path, {_QUERY} q FROM pages),
 c AS (SELECT *, REGEXP_REPLACE(host, '^www\.', '') || REGEXP_REPLACE(path, '(/|\.html)$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END canon, CASE {_CASES} END r FROM p),
 listed AS (SELECT DISTINCT canon FROM c WHERE canon <> '' AND REGEXP_MATCHES(host, '{_LISTED}'))
SELECT page_id, host, path, r.rule AS rule, COALESCE(r.v, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) verdict FROM c"""

SQL["op7_substring_dedup"] = r"""WITH d AS (SELECT doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
 win AS (SELECT doc_id, UNNEST(LIST_TRANSFORM(range(1, LEN(w) - 48), lambda k: {'k': k, 'h': SHA256(ARRAY_TO_STRING(w[k : k + 49], ' '))})) x FROM d WHERE LEN(w) >= 50),
 first AS (SELECT x.h h, MIN(doc_id) lo FROM win GROUP BY 1), gone AS (SELECT DISTINCT doc_id, UNNEST(range(x.k, x.k + 50)) p FROM win JOIN first ON first.h = x.h WHERE lo < doc_id),
 each AS (SELECT doc_id, UNNEST(w) word, UNNEST(range(1, LEN(w) + 1)) p FROM d),
 kept AS (SELECT doc_id, COUNT(*) n, STRING_AGG(word, ' ' ORDER BY p) t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(LEN(w) AS BIGINT) n_words, CAST(LEN(w) - COALESCE(n, 0) AS BIGINT) n_removed, SHA256(COALESCE(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
