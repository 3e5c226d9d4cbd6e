"""DuckDB SQL for the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

CELL = "CASE WHEN x < 16 THEN x ELSE (length(bin(x)) - 5) * 16 + (x >> (length(bin(x)) - 5)) END"
FLOOR = "CASE WHEN c < 16 THEN c ELSE ((c - (c // 16 - 1) * 16)::BIGINT << (c // 16 - 1)::INT) END"

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos
), gap AS (
  SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS g FROM tri WHERE n >= 2
), rep AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gap GROUP BY 1
), m AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT * EXCLUDE (lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m
), fig AS (
  SELECT f.*, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS f_symbols, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS f_length,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS f_repeats, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS f_lines,
    CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS f_capitals FROM f
), long AS (
  SELECT lang, source, u.name AS name, u.least AS least, u.x AS x FROM fig, unnest([
    {{'name': 'symbols', 'least': 60, 'x': f_symbols}}, {{'name': 'length', 'least': 60, 'x': f_length}}, {{'name': 'repeats', 'least': 150, 'x': f_repeats}},
    {{'name': 'lines', 'least': 150, 'x': f_lines}}, {{'name': 'capitals', 'least': 60, 'x': f_capitals}}]) AS t(u) WHERE n_words > 0
), cells AS (
  SELECT lang, source, name, least, {CELL} AS c, count(*) AS n, CASE WHEN grouping(source) = 0 THEN 0 WHEN grouping(lang) = 0 THEN 1 ELSE 2 END AS level
  FROM long GROUP BY GROUPING SETS ((lang, source, name, least, c), (lang, name, least, c), (name, least, c))
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, name ORDER BY c) AS upto, sum(n) OVER (PARTITION BY level, lang, source, name) AS total FROM cells
), quart AS (
  SELECT level, lang, source, name, least, total, min(c) FILTER (4 * upto >= total) AS c1, min(c) FILTER (4 * upto >= 3 * total) AS c3 FROM cum GROUP BY ALL
), q AS (
  SELECT level, lang, source, name, total, least, (SELECT {FLOOR} FROM (SELECT c1 AS c)) AS q1, (SELECT {FLOOR} FROM (SELECT c3 AS c)) AS q3 FROM quart
), fence AS (
  SELECT level, lang, source, name, total, q1 - 3 * greatest(q3 - q1, least) AS lo, q3 + 3 * greatest(q3 - q1, least) AS hi FROM q
), wide AS (
  SELECT level, lang, source, max(total) AS total, max(hi) FILTER (name = 'symbols') AS h1, max(hi) FILTER (name = 'length') AS h2, max(lo) FILTER (name = 'length') AS l2,
    max(hi) FILTER (name = 'repeats') AS h3, max(hi) FILTER (name = 'lines') AS h4, max(hi) FILTER (name = 'capitals') AS h5 FROM fence GROUP BY ALL
), best AS (
  SELECT a.lang, a.source, CASE WHEN a.total >= 200 THEN a WHEN b.total >= 200 THEN b ELSE c END AS k
  FROM wide a JOIN wide b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN wide c ON c.level = 2 WHERE a.level = 0
), v AS (
  SELECT fig.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(f_symbols > k.h1 OR f_length > k.h2 OR f_length < k.l2 OR f_repeats > k.h3 OR f_lines > k.h4 OR f_capitals > k.h5, false) AS beyond
  FROM fig LEFT JOIN best ON fig.lang IS NOT DISTINCT FROM best.lang AND fig.source IS NOT DISTINCT FROM best.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM v
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s
), item AS (SELECT doc_id, hash(unnest(s)) AS h FROM s
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM item a JOIN item b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), two AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT two.a, reach.seen FROM reach JOIN two ON two.b = reach.node
), comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp ON node = doc_id
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(0.1 + 0.9 * length(regexp_replace(text, '[^\p{L}\s]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.1) AS w,
    (('0x' || md5_number_prefix)::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM (SELECT *, substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':11'), 1, 12) AS md5_number_prefix FROM documents)
), k AS (
  SELECT doc_id, source, size, least(floor((1 - pow(u, 1 / w)) * 1099511627776.0), 1099511627775)::BIGINT AS x FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS i FROM s
), c AS (
  SELECT *, coalesce(sum(stop) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total FROM r
), lam AS (
  SELECT first((1.5::DOUBLE * total - capped) / open ORDER BY i) AS rate FROM c WHERE w * ((1.5::DOUBLE * total - capped) / open) < stop
), t AS (
  SELECT source, source_size, least(stop, w * rate) AS target FROM r, lam
), p AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t
), o AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY x, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
), q AS (
  SELECT *, round(least(greatest(budget - start, 0), size))::BIGINT AS part FROM o
), e AS (
  SELECT *, coalesce(min(CASE WHEN start + size >= budget THEN x END) OVER (PARTITION BY source), max(x) OVER (PARTITION BY source)) AS stop_at FROM q
)
SELECT doc_id, size, source_size, target, epochs * size + part AS taken,
  epochs + CASE WHEN size > 0 THEN (2 * part > size)::BIGINT ELSE (x < stop_at)::BIGINT END AS copies FROM e
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.98
), n AS (SELECT a, count(*)::BIGINT AS n FROM link GROUP BY 1
), reach(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT link.a, reach.seen FROM reach JOIN link ON link.b = reach.node
), comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""

_RULES = "(VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rh, rp, say)"

URL_FILTERS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, coalesce(regexp_extract(url, '^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1, 's'), '') AS rest FROM pages
), node AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || rest END AS node FROM p
), raw AS (
  SELECT node, regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS link FROM node
  UNION ALL SELECT node, regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') FROM node
), full_ AS (
  SELECT node, CASE WHEN contains(link, '://') THEN link WHEN link LIKE '//%' THEN 'x:' || link WHEN link LIKE '/%' THEN 'x://' || split_part(node, '/', 1) || link
    ELSE 'x://' || regexp_replace(split_part(node, '?', 1), '[^/]*$', '') || link END AS link FROM raw WHERE link <> '' AND node IS NOT NULL
), edge AS (
  SELECT node AS a, translate(regexp_extract(link, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(link, '://[^/?#]*([^#]*)', 1), '^(\?|$)', '/\1') AS b FROM full_
), two AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach(node, seen) AS (
  SELECT a, a FROM two UNION SELECT two.a, reach.seen FROM reach JOIN two ON two.b = reach.node
), ends AS (
  SELECT DISTINCT node, regexp_extract(node, '^([^/?]*)', 1) AS host, regexp_extract(node, '^[^/?]*([^?]*)', 1) AS path FROM reach
), endrule AS (
  SELECT node, arg_max(say, length(rh) + length(rp)) AS say FROM ends JOIN {_RULES} ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY 1
), spread AS (SELECT reach.node, min(say) AS spread FROM reach JOIN endrule ON endrule.node = seen GROUP BY 1
), own AS (
  SELECT page_id, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(say, length(rh) + length(rp)) AS say FROM p
  JOIN {_RULES} ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(say, spread, 'allow') AS verdict FROM node LEFT JOIN own USING (page_id) LEFT JOIN spread USING (node)
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), tok AS (SELECT r, lang, source, unnest(t) AS item FROM d
), kept AS (SELECT lang, item FROM tok GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1
), grp AS (SELECT DISTINCT lang, source FROM d
), n AS (SELECT lang, source, item, count(*)::HUGEINT AS n FROM tok JOIN kept USING (lang, item) GROUP BY 1, 2, 3
), total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM n GROUP BY 1, 2
), g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, v FROM grp JOIN v USING (lang) LEFT JOIN total USING (lang, source)
), p AS (
  SELECT lang, source, item, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, item)
), q AS (
  SELECT lang, item, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(lt.total) + any_value(v)) AS q
  FROM n JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM total GROUP BY 1) lt USING (lang) JOIN v USING (lang) GROUP BY 1, 2
), term AS (
  SELECT lang, source, 'term' AS part, item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, item) WHERE n > 0 AND p > q
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY 1, 2, 4
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM (SELECT * FROM term UNION ALL SELECT * FROM pairs) QUALIFY part = 'pair' OR rank <= 200
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (
  SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT l FROM asked
), runs AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)
), hit AS (SELECT r, i, l, item FROM runs JOIN asked USING (l, win)
), cover AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS j FROM hit) GROUP BY 1
), named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""
