"""SQL equivalents of the queries that SQL can express, for whole tables at small scale."""

from __future__ import annotations

from .licenses import CONTAINMENT, PHRASES, TEMPLATES

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+')"
_PLAIN = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""WITH RECURSIVE w AS (SELECT DISTINCT doc_id, {_SPACED} AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS g FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 2))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

_values = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)

#: Notices that go over line breaks are not expressed here; tests compare them with all runs of words.
OP3 = f"""WITH w AS (SELECT doc_id, {_PLAIN} AS t FROM documents), ph(phrase, label) AS (VALUES {_values(PHRASES)}),
b AS (SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, t, string_split(phrase, ' ') AS p, label, unnest(generate_series(1, len(t) - len(string_split(phrase, ' ')) + 1)) AS i FROM w, ph) WHERE t[i:i + len(p) - 1] = p),
tm(template, label) AS (VALUES {_values(TEMPLATES)}),
tw AS (SELECT template, label, word, len(words) AS size FROM (SELECT template, label, list_distinct(string_split(template, ' ')) AS words, unnest(list_distinct(string_split(template, ' '))) AS word FROM tm)),
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
lw AS (SELECT DISTINCT doc_id, line, unnest({_PLAIN}) AS word FROM ln),
m AS (SELECT doc_id, line, label, count(*) / any_value(size) AS share FROM lw JOIN tw USING (word) GROUP BY doc_id, line, template, label HAVING count(*) >= ceil({CONTAINMENT} * any_value(size) - 1e-9)),
bl AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, len(t)::BIGINT AS n_words, coalesce(bl.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
(CASE WHEN bl.n > 0 THEN 1.0 ELSE coalesce(share, 0) END)::DOUBLE AS score FROM w LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN best USING (doc_id)"""

OP6 = """WITH RECURSIVE j AS (
SELECT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)
UNION ALL SELECT doc_id, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM j WHERE j < 25)),
s AS (SELECT doc_id, max(b) FILTER (b < 24)::INT AS shard, max(b)::INT AS grown_shard FROM j WHERE b < 25 GROUP BY doc_id),
poly AS (SELECT 0 AS step, i::BIGINT AS i, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT step + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE step = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
  strlen(coalesce(text, ''))::BIGINT + 8 AS size FROM documents, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM crc JOIN s USING (doc_id)"""

OP9 = f"""WITH w AS (SELECT DISTINCT doc_id, {_PLAIN} AS t FROM documents), iw AS (SELECT item_id, {_PLAIN} AS t FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(t), 10) AS n, array_to_string(t[i:i + least(len(t), 10) - 1], ' ') AS g FROM (SELECT item_id, t, unnest(generate_series(1, greatest(1, len(t) - 9))) AS i FROM iw WHERE len(t) > 0)),
ns AS (SELECT DISTINCT n FROM win),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(t[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM w, ns WHERE len(t) >= n)) JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hits GROUP BY doc_id)
SELECT d.doc_id, len({_PLAIN})::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

_CRC = """poly AS (SELECT 0 AS step, i::BIGINT AS i, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT step + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE step = 8)"""

#: The columns of op4 that do not depend on the trained model.
BASE4 = f"""WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 7 = 2 AS held_out FROM documents, tab),
w AS (SELECT row_number() OVER () AS r, doc_id, held_out, list_append({_SPACED}, ' ') AS t FROM d),
e AS (SELECT r, doc_id, held_out, unnest(t) AS word FROM w), c AS (SELECT word, count(*) AS c FROM e WHERE NOT held_out GROUP BY word), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT e.doc_id, e.held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))), 3) AS base_score FROM e LEFT JOIN c USING (word), s GROUP BY e.r, e.doc_id, e.held_out"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The columns of op5 that do not depend on the trained model.
BASE5 = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS t FROM documents),
g AS (SELECT r, i, t[i:i + 2] AS g FROM (SELECT r, t, unnest(generate_series(1, len(t) - 2)) AS i FROM w)),
m AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM m, range(3) k(k) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN t]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(t) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(t) AS base_failed FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r)"""
