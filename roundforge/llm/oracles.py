"""SQL for the queries of this subpackage that SQL can express."""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (SELECT doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
grams AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS p FROM counted, (SELECT unnest(generate_series(0, 4)) AS k) WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, line, regexp_replace(lower(trim(regexp_replace(line, '[ \x09\x0B\x0C\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
 FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
identity AS (SELECT doc_id, md5(t) AS identity FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT identity) AS n FROM d JOIN identity USING (doc_id) GROUP BY host),
frequent AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT identity) AS n_docs FROM lines JOIN identity USING (doc_id) GROUP BY host, h) JOIN hosts USING (host) WHERE n_docs > 10 AND n_docs > 0.02 * n),
removed AS (SELECT doc_id, sum(words)::BIGINT AS removed_words FROM lines SEMI JOIN frequent USING (host, h) GROUP BY doc_id),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - removed_words < 10 OR n_words - removed_words < 0.1 * n_words AS depleted FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, removed_words, depleted FROM k
"""

OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
 UNION ALL SELECT doc_id, len(w)::VARCHAR || '|' || array_to_string(w, ' ') FROM d WHERE len(w) < 5),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * o >= 8 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM d
"""

OP11 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN wins USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t.doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), t.doc_id > min(t.doc_id) OVER (PARTITION BY t)] AS fails,
 coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM t LEFT JOIN labels USING (doc_id)),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT p.c || q.c || r.c || s.c || u.c AS filter_order FROM c p, c q, c r, c s, c u WHERE len(list_distinct([p.c, q.c, r.c, s.c, u.c])) = 5),
gone AS (SELECT doc_id, part, good, bad, fails, filter_order, list_min(list_transform(list_filter(generate_series(1, 5), lambda i: fails[i]), lambda i: instr(filter_order, chr((64 + i)::INTEGER)))) AS gone_at FROM f, o),
steps AS (SELECT part, filter_order, k::INTEGER AS step, substr(filter_order, k, 1) AS letter,
 count(*) FILTER (gone_at IS NULL OR gone_at > k) AS kept, count(*) FILTER (gone_at = k) AS removed, count(*) FILTER (gone_at < k AND fails[ascii(substr(filter_order, k, 1)) - 64]) AS redundant,
 count(*) FILTER (gone_at = k AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails, count(*) FILTER (gone_at = k AND good) AS good_lost, count(*) FILTER (gone_at = k AND bad) AS toxic_lost
 FROM gone, (SELECT unnest(generate_series(1, 5)) AS k) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM steps
"""
