"""DuckDB twins of the queries that SQL can express (sf0.01 in seconds).

Fixed values (word classes, rules, window lengths) are the contract's; each
query is written on its own, from the plain definition.
"""

from __future__ import annotations

_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<s>|</s>|\[/?INST\]|\[/?ROLE\]|\[END\])', '#\1', 'g') AS long_text,
         regexp_replace(replace(role, '\', '\\'), '(<s>|</s>|\[/?INST\]|\[/?ROLE\]|\[END\])', '#\1', 'g') AS long_role FROM rows),
agg AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length(long_text) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(long_role) END) AS formatted_chars
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM agg
"""

_OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_ASCII.format('text')}, {_SPACED}) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""

#: The same definition with shingles of four words and the kept mark.
_OP11 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_ASCII.format('text')}, {_SPACED}) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""

_OP13 = """
WITH rows AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
   AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

_OP8 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_ASCII.format('text')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_ASCII.format('text')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + 12])) AS win
  FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
spots AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM words, lengths WHERE len(w) >= n),
hits AS (
  SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM spots) JOIN windows USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM documents d JOIN words w USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP9 = rf"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS at FROM windows JOIN firsts USING (h) WHERE f < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM words),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at) AS body, count(*) AS n
  FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.at = c.at GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""

_OP3 = r"""
WITH urls AS (
  SELECT page_id, """ + _ASCII.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)") + r""" AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, action, domain, prefix) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
ruled AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM urls LEFT JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY ALL),
bad AS (
  SELECT doc_id AS page_id, max(toxic = 1 OR quality = 0) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1),
named AS (
  SELECT DISTINCT page_id, host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS name FROM urls),
hosts AS (
  SELECT name, CASE WHEN regexp_full_match(name, '[0-9]+(\.[0-9]+){3}') OR starts_with(name, '[') THEN name ELSE string_split(name, '.')[-1] END AS suffix,
         CASE WHEN regexp_full_match(name, '[0-9]+(\.[0-9]+){3}') OR starts_with(name, '[') OR NOT contains(name, '.') THEN name
              ELSE string_split(name, '.')[-2] || '.' || string_split(name, '.')[-1] END AS domain,
         CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad::INT), 0) AS DOUBLE) AS k
  FROM (SELECT DISTINCT page_id, name FROM named) LEFT JOIN bad USING (page_id) GROUP BY name),
base AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS p FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT p FROM base) AS p FROM hosts GROUP BY 1),
s1 AS (SELECT coalesce(sum(n * pow(k / n - p, 2) - p * (1 - p)) / nullif(sum((n - 1) * p * (1 - p)), 0), 0) AS rho FROM s0 WHERE n > 0),
s2 AS (SELECT suffix, (m * p + k) / (m + n) AS rate FROM s0, (SELECT 1 / least(0.5, greatest(0.001, rho)) - 1 AS m FROM s1)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(rate) AS p FROM hosts JOIN s2 USING (suffix) GROUP BY 1, 2),
d1 AS (SELECT coalesce(sum(n * pow(k / n - p, 2) - p * (1 - p)) / nullif(sum((n - 1) * p * (1 - p)), 0), 0) AS rho FROM d0 WHERE n > 0),
d2 AS (SELECT domain, (m * p + k) / (m + n) AS rate FROM d0, (SELECT 1 / least(0.5, greatest(0.001, rho)) - 1 AS m FROM d1)),
h0 AS (SELECT name, n, k, rate AS p FROM hosts JOIN d2 USING (domain)),
h1 AS (SELECT coalesce(sum(n * pow(k / n - p, 2) - p * (1 - p)) / nullif(sum((n - 1) * p * (1 - p)), 0), 0) AS rho FROM h0 WHERE n > 0),
h2 AS (SELECT name, (m * p + k) / (m + n) AS rate, m + n AS w FROM h0, (SELECT 1 / least(0.5, greatest(0.001, rho)) - 1 AS m FROM h1))
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) > p THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN (SELECT DISTINCT page_id, host, name FROM named) USING (page_id, host) LEFT JOIN h2 USING (name), base
"""

ORACLES: dict[str, str] = {
    "op2_chat_format": _OP2,
    "op3_url_filter": _OP3,
    "op4_ngram_jaccard_join": _OP4,
    "op8_decontamination": _OP8,
    "op9_substring_dedup": _OP9,
    "op11_minhash_dedup": _OP11,
    "op13_hard_negatives": _OP13,
}
