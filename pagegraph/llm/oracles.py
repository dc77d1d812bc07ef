"""SQL twins of the queries that SQL can express, for the same tables."""

#: words of a text as the contracts have them
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

TOP_K = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""".format(_USABLE)

VECTOR_LINKS = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND {}),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.c),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id""".format(_USABLE)

SHINGLE_GROUPS = """WITH RECURSIVE w AS (SELECT doc_id, {} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.c),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), l AS (SELECT a, count(*) AS links FROM p GROUP BY a),
z AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS class_id FROM (SELECT doc_id, list(gram ORDER BY gram) AS grams FROM g GROUP BY doc_id))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(links, 0) AS n_links, coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN l ON l.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id""".format(
    _WORDS.format(_LOWER)
)

ARCHIVED = """WITH h AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, CASE WHEN b >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS head FROM h)
SELECT page_id, b AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > head THEN head END AS refers_to FROM f"""

WITHOUT_REPEATS = """WITH w AS (SELECT doc_id, {} AS ws FROM documents),
v AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM v) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(generate_series(0, 19)) AS pos FROM late),
every AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM every ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""".format(_WORDS.format("text"))

INFILLED = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

# crc32 bit by bit over the ASCII digits of an id (fixed polynomial)
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

PREFIX_TRIE = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS part, t.ord, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.ord <= h UNION ALL SELECT t.conv_id, 1, t.ord, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.ord > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list({{'r': r, 'x': x}}) OVER w AS path, x FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, ord ROWS UNBOUNDED PRECEDING)),
a AS (SELECT conv_id, depth, path, x FROM p UNION ALL SELECT conv_id, 0, [], '' FROM c),
f AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM a),
n AS (SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(len({})) AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM f GROUP BY path),
i AS (SELECT f.conv_id AS member, f.depth, n.conv_id AS id, own FROM f JOIN n ON n.path = f.path),
k AS (SELECT up.id AS parent, up.depth, count(DISTINCT down.id) AS n_children FROM i up JOIN i down ON down.member = up.member AND down.depth = up.depth + 1 GROUP BY ALL),
l AS (SELECT i.depth, id, own, n_children IS NULL AS leaf FROM (SELECT DISTINCT depth, id, own FROM i) i LEFT JOIN k ON k.parent = id AND k.depth = i.depth),
s AS (SELECT depth, id, count(*) FILTER (WHERE leaf) AS n_leaves, sum(below_own) AS saved FROM
  (SELECT DISTINCT up.depth, up.id, l.depth AS d, l.id AS below, l.leaf, l.own AS below_own FROM i up JOIN i down ON down.member = up.member AND down.depth >= up.depth JOIN l ON l.depth = down.depth AND l.id = down.id) GROUP BY ALL),
u AS (SELECT DISTINCT down.id, down.depth, up.id AS parent_conv_id FROM i down JOIN i up ON up.member = down.member AND up.depth = down.depth - 1)
SELECT n.conv_id, n.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.id = n.conv_id LEFT JOIN k ON k.parent = n.conv_id AND k.depth = n.depth LEFT JOIN u ON u.id = n.conv_id AND u.depth = n.depth""".format(_CRC, _WORDS.format("x"))

ORACLES = {
    "op1_topk": TOP_K,
    "op4_neardup": VECTOR_LINKS,
    "op7_jaccard": SHINGLE_GROUPS,
    "op8_warc": ARCHIVED,
    "op9_substring": WITHOUT_REPEATS,
    "op11_infill": INFILLED,
    "op13_trie": PREFIX_TRIE,
}
