"""SQL for the operators that SQL can express, for DuckDB over the same tables."""

SUBSTRING = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5_number(array_to_string(w[i:i + 19], ' ')))) AS k FROM doc),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM doc),
mark AS (SELECT word.doc_id, word.i, word.w, coalesce(bool_or(late.i IS NOT NULL) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM word LEFT JOIN late ON late.doc_id = word.doc_id AND late.i = word.i)
SELECT doc.doc_id, count(mark.i) AS n_words, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(mark.w, ' ' ORDER BY mark.i) FILTER (NOT gone), '')) AS kept_sha256
FROM doc LEFT JOIN mark ON mark.doc_id = doc.doc_id GROUP BY doc.doc_id
"""

#: Says what the pages of the tables hold: one article element of h1 and p blocks, with the basic entities.
HTML = r"""
WITH part AS (SELECT page_id, unnest(range(len(b))) AS i, unnest(b) AS t FROM (SELECT page_id, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS b FROM pages)),
clean AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM part)
SELECT p.page_id, p.url, coalesce(c.text, '') AS text, length(coalesce(c.text, '')) AS n_chars
FROM pages p LEFT JOIN (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM clean WHERE t <> '' GROUP BY page_id) c ON c.page_id = p.page_id
"""

DECONTAMINATION = r"""
WITH word AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
iword AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM iword WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS shingle FROM word, k),
b AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS shingle FROM iword WHERE len(w) > 0),
size AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
pair AS (SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM d JOIN b USING (k, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM pair JOIN size USING (item_id) WHERE n_shared / n_item >= 0.8
"""

EXACT = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)
"""


def license_sql(templates: list[tuple[str, bool, list[str]]], k: int, drift: int, cover: float) -> str:
    """The license scan for templates given as (label, base phrase or not, words)."""
    rows = ", ".join(f"({n}, '{label}', {str(base).lower()}, {words!r})" for n, (label, base, words) in enumerate(templates))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, label, base, w)),
tg AS (SELECT template, unnest(range(len(w) - {k - 1})) AS tp, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, unnest(range(len(w) - {k - 1})) AS place, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM d WHERE len(w) >= {k}),
one AS (SELECT doc_id, template, place - tp AS diagonal, list(tp) AS ats FROM dg JOIN tg USING (g) GROUP BY ALL),
step AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {drift} THEN 0 ELSE 1 END AS new FROM one),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM step),
word AS (SELECT doc_id, template, grp, count(DISTINCT tp + j) AS covered FROM (SELECT doc_id, template, grp, unnest(ats) AS tp FROM grouped), range({k}) r(j) GROUP BY ALL),
share AS (SELECT doc_id, label, covered / len(t.w) AS share FROM word JOIN t USING (template)),
place AS (SELECT doc_id, label, diagonal FROM one JOIN t USING (template) WHERE base AND len(ats) = len(t.w) - {k - 1}),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY 1),
m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {cover}) AS labels, max(share) AS score FROM share GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def clustering_sql(dimensions: int, clusters: int, rounds: int) -> str:
    """K-means over integer vectors, one round after the other."""
    far = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    nearest = lambda r: f"a{r} AS MATERIALIZED (SELECT id, vec_id, v, j, d FROM (SELECT v.id, v.vec_id, v.v, c.j, {far} AS d, row_number() OVER (PARTITION BY v.id ORDER BY {far}, c.j) AS n FROM v CROSS JOIN c{r} c) WHERE n = 1)"
    moved = lambda r: f"m{r} AS (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT j, unnest(range({dimensions})) AS i, unnest(v) AS x FROM a{r}) GROUP BY ALL) GROUP BY j), c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j)"
    steps = ", ".join(f"{nearest(r)}, {moved(r)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, v AS c FROM v QUALIFY j < {clusters}),
{steps}, {nearest(rounds)}
SELECT a.vec_id, a.j::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j
"""


#: crc32 of a decimal number is folded bit by bit; levels of a tree are grouped until one node is left.
MERKLE = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(doc_id::VARCHAR))), lambda c, i: xor(CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))) ELSE c END >> 1, CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))) ELSE c END) % 2 = 1 THEN 3988292384 ELSE 0 END)) AS crc,
  concat(strlen(doc_id::VARCHAR) || ':' || doc_id, coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS lvl, pos, leaf AS h, n FROM l UNION ALL SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lvl, n, pos // 16),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM s UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, n, pos // 16),
sides AS (SELECT source, lvl, pos, n, coalesce(string_agg(h, '') OVER (PARTITION BY source, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY source, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM t),
tops AS (SELECT lvl, pos, n, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM u),
f AS (SELECT doc_id, source, pos, 0 AS lvl, coalesce(changed, leaf) AS h, '' AS proof FROM l
  UNION ALL SELECT f.doc_id, f.source, f.pos // 16, f.lvl + 1, sha256(a || f.h || b), f.proof || a || b FROM f JOIN sides x ON x.source IS NOT DISTINCT FROM f.source AND x.lvl = f.lvl AND x.pos = f.pos AND x.n > 1),
g AS (SELECT f.doc_id, s.subroot, s.pos, 0 AS lvl, f.h, f.proof FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.n = 1 JOIN s ON s.source IS NOT DISTINCT FROM f.source
  UNION ALL SELECT g.doc_id, g.subroot, g.pos // 16, g.lvl + 1, sha256(a || g.h || b), g.proof || a || b FROM g JOIN tops x ON x.lvl = g.lvl AND x.pos = g.pos AND x.n > 1)
SELECT l.doc_id, l.leaf, g.subroot, u.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified FROM l JOIN g ON g.doc_id = l.doc_id JOIN u ON u.n = 1 AND u.lvl = g.lvl
"""
