"""SQL (DuckDB) that gives the rows of the queries which SQL can tell."""

#: The repeated 50-byte windows; bytes are handled as pairs of hexadecimal digits.
REPEATS = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n FROM t),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50)),
m AS (SELECT w, min(doc_id) AS first FROM s GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT s.doc_id, s.i FROM s JOIN m ON m.w = s.w WHERE m.first < s.doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM f),
x AS (SELECT b.doc_id, any_value(b.n) AS n, count(c.i) AS removed, count(c.i) FILTER (WHERE p.i IS NULL) AS spans FROM b LEFT JOIN c ON c.doc_id = b.doc_id LEFT JOIN c p ON p.doc_id = c.doc_id AND p.i = c.i - 1 GROUP BY 1),
k AS (SELECT e.doc_id, string_agg(e.x, '' ORDER BY e.i) AS h FROM (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT b.doc_id, h, unnest(range(0, n)) AS i FROM b)) e ANTI JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY 1)
SELECT x.doc_id, n AS n_bytes, removed AS n_removed, spans AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256 FROM x LEFT JOIN k ON k.doc_id = x.doc_id
"""

#: Five-word shingles, pairs that reach 0.75, and the least id reachable.
NGRAM_COMPONENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
