"""SQL that gives the rows of the operators which SQL can express, for small tables."""

_WORDS = "regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')"

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t="translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS s FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT r.id, b.y FROM r JOIN both_ways b ON r.m = b.x)
SELECT id AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text,'')")} AS ws FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(ws[i:i+19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, s + j AS p FROM gone, range(0, 20) AS r(j)),
words AS (SELECT doc_id, i AS p, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
