"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"
_PLAIN = r"regexp_extract_all({}, '[^\x{{20}}\x{{09}}-\x{{0D}}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, coalesce({_ALNUM}, []) AS w FROM benchmark),
iw AS (SELECT DISTINCT i.r AS i, item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS words
  FROM i, generate_series(1, greatest(len(w) - 9, 1)) AS g(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT d.r, s, size, array_to_string(w[s:s + size - 1], ' ') AS words FROM d, sizes, generate_series(1, len(w) - size + 1) AS g(s) WHERE len(w) >= size),
hits AS (SELECT dw.r, dw.s, dw.size, iw.i, iw.item_id FROM dw JOIN iw USING (size, words)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + size - 1)) AS p FROM (SELECT DISTINCT r, s, size FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, i, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_PLAIN.format("text")}, []) AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM d, generate_series(1, len(w) - 34) AS g(s) WHERE len(w) >= 35),
hot AS (SELECT r, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(s, s + 34)) AS p FROM hot),
words AS (SELECT r, p, w[p] AS word FROM d, generate_series(1, len(w)) AS g(p) WHERE len(w) > 0),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

JACCARD = f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS class_id, count(*) AS size FROM documents GROUP BY 1),
n AS (SELECT row_number() OVER () AS k, *, {_PLAIN.format(_LOWER.format("text"))} AS w FROM t),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM n, generate_series(1, greatest(len(w) - 4, 1)) AS q(i) WHERE len(w) > 0),
c AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.k = a JOIN c y ON y.k = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-6),
links AS (SELECT a AS k, count(*) AS n_text_links, sum(size) AS n FROM l JOIN n ON n.k = b GROUP BY 1),
reach(k, m) AS (SELECT k, k FROM n UNION SELECT reach.k, l.b FROM reach JOIN l ON l.a = reach.m),
g AS (SELECT reach.k, min(n.class_id) AS group_id FROM reach JOIN n ON n.k = reach.m GROUP BY 1)
SELECT doc_id, class_id, size AS class_size, CAST(size - 1 + coalesce(links.n, 0) AS BIGINT) AS n_links, coalesce(n_text_links, 0) AS n_text_links, group_id
FROM documents JOIN n ON n.text = coalesce(documents.text, '') JOIN g USING (k) LEFT JOIN links USING (k)
"""
