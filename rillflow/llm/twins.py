"""The same results in SQL for DuckDB, by plainer means: every line, window and string is listed."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TOKENS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
),
words AS (SELECT r, {_WORDS.format('text')} AS w FROM docs),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM words, unnest(range(1, len(w) - 1)) t(i)),
twice AS (SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1),
repeats AS (
  SELECT r, count(DISTINCT j) AS n FROM windows JOIN twice USING (r, win), unnest([i, i + 1, i + 2]) t(j) GROUP BY r
),
lines AS (
  SELECT r, host, text, line, {_WORDS.format(_LOWER.format('line'))} AS w FROM docs, unnest(string_split(text, chr(10))) t(line)
),
keyed AS (SELECT r, host, text, line, array_to_string(w, ' ') AS key, len(w) AS n FROM lines WHERE len(w) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM keyed GROUP BY r),
hosts AS (SELECT host, greatest(20, 0.1 * count(DISTINCT text)) AS most FROM docs GROUP BY host),
frequent AS (
  SELECT host, key FROM (SELECT host, key, count(DISTINCT text) AS n FROM keyed GROUP BY host, key) JOIN hosts USING (host) WHERE n > most
),
lost AS (SELECT r, sum(n) AS n FROM keyed JOIN frequent USING (host, key) GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM docs JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - lost_words >= 0.5 * n_words AS kept FROM based
"""

BENCHMARK = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS win FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i)
  WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TOKENS}, []) AS w FROM documents),
places AS (SELECT r, i, n, w[i : i + n - 1] AS win FROM docs, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT r, i, places.n AS n, item FROM places JOIN windows USING (win)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) t(j) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
