"""SQL for the queries that it can express, over whole tables.

Language identification, scores of the language model, decontamination, quality verdicts (quantile sketches draw random
numbers), byte-level BPE, chat formatting, toxicity and the pipeline have none; tests hold them against plain versions."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS d FROM docs),
lines AS (SELECT d, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT d, string_split(text, chr(10)) AS l FROM ordered)),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
summed AS (SELECT *, sum(n) OVER (PARTITION BY d ORDER BY i) AS z, sum(n) OVER (PARTITION BY d ORDER BY i) - n AS a FROM counted),
forward AS (SELECT s.d, s.i AS first, min(e.i) AS last FROM summed s JOIN summed e ON s.d = e.d AND e.i >= s.i AND e.z - s.a >= 50 GROUP BY ALL),
backward AS (SELECT e.d, max(s.i) AS first, e.i AS last FROM summed s JOIN summed e ON s.d = e.d AND e.i >= s.i AND e.z - s.a >= 50 GROUP BY e.d, e.i),
runs AS (SELECT w.d, w.first, w.last, string_agg(c.line, chr(10) ORDER BY c.i) AS body FROM (SELECT * FROM forward UNION SELECT * FROM backward) w JOIN counted c ON c.d = w.d AND c.i BETWEEN w.first AND w.last GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body, last - first ORDER BY d, first) AS copy FROM runs),
gone AS (SELECT DISTINCT c.d, c.i FROM ranked r JOIN counted c ON c.d = r.d AND c.i BETWEEN r.first AND r.last WHERE copy > 1),
marked AS (SELECT c.d, c.i, c.line, g.i IS NOT NULL AS gone, lag(g.i IS NOT NULL, 1, false) OVER (PARTITION BY c.d ORDER BY c.i) AS before FROM counted c LEFT JOIN gone g ON c.d = g.d AND c.i = g.i),
result AS (SELECT d, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY d)
SELECT t.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs, coalesce(r.kept_sha256, sha256('')) AS kept_sha256
FROM documents t LEFT JOIN ordered o ON t.doc_id IS NOT DISTINCT FROM o.doc_id AND t.text = o.text LEFT JOIN result r ON r.d = o.d
"""

JACCARD = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 9 * count(*) >= 4 * (x.n + y.n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
equal AS (SELECT r, count(*) OVER (PARTITION BY list) AS copies FROM (SELECT r, string_agg(s, chr(10) ORDER BY s) AS list FROM shingles GROUP BY r)),
least AS (SELECT reach.a AS r, min(w.doc_id) AS c FROM reach JOIN words w ON w.r = reach.b GROUP BY reach.a)
SELECT w.doc_id, coalesce(least(l.c, w.doc_id), w.doc_id) AS class_id, coalesce(e.copies, 1) AS n_copies, (SELECT count(*) FROM links WHERE links.a = w.r) AS n_links
FROM words w LEFT JOIN equal e ON e.r = w.r LEFT JOIN least l ON l.r = w.r
"""

REPEATS = r"""
WITH bytes AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, md5(substring(h, 2 * i + 1, 800)) AS w FROM (SELECT r, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 399)) AS i FROM bytes WHERE length(h) >= 800)),
copied AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
breaks AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM copied),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM breaks) GROUP BY r, g),
gaps AS (SELECT b.r, s.a, coalesce(lag(s.z) OVER (PARTITION BY b.r ORDER BY s.a), 0) AS before, substring(b.h, 2 * coalesce(lag(s.z) OVER (PARTITION BY b.r ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.z) OVER (PARTITION BY b.r ORDER BY s.a), 0))) AS piece FROM bytes b JOIN spans s ON s.r = b.r),
found AS (SELECT r, sum(z - a) AS removed, count(*) AS n, max(z) AS last FROM spans GROUP BY r),
heads AS (SELECT r, string_agg(piece, '' ORDER BY a) AS head FROM gaps GROUP BY r)
SELECT b.doc_id, CAST(length(b.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(f.removed, 0) AS BIGINT) AS n_removed, coalesce(f.n, 0) AS n_spans,
  sha256(unhex(coalesce(h.head || substring(b.h, 2 * f.last + 1), b.h))) AS kept_sha256 FROM bytes b LEFT JOIN found f ON f.r = b.r LEFT JOIN heads h ON h.r = b.r
"""

SQL = {"op1_line_dedup": LINE_DEDUP, "op4_ngram_jaccard": JACCARD, "op5_suffix_dedup": REPEATS}
