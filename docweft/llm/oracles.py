"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

#: The pattern of a word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)]
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT sym.y, reach.comp FROM reach JOIN sym ON sym.x = reach.node
), c AS (SELECT node AS doc_id, min(comp) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""

OP9 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) AS r(i) WHERE len(ws) >= 35
), dup AS (
  SELECT doc_id, i FROM win WHERE hash(s) IN (SELECT hash(s) FROM win GROUP BY 1 HAVING count(*) > 1)
    AND s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM dup, unnest(range(0, 35)) AS r(k)
), word AS (
  SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(i)
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c != 0)) > 0
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (SELECT vec_id AS node, vec_id AS comp FROM embeddings UNION SELECT sym.y, reach.comp FROM reach JOIN sym ON sym.x = reach.node
), c AS (SELECT node AS vec_id, min(comp) AS component_id FROM reach GROUP BY node
), n AS (SELECT x AS vec_id, count(*) AS n FROM sym GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""

#: Kind, pattern with both cases spelled out, least length, and the group it holds for.
SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"\']?\x20*[:=]\x20*[\"\']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", 24, 0),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _op3() -> str:
    parts, spans = [], []
    for rank, (kind, pattern, least, group) in enumerate(SECRETS):
        quoted = pattern.replace("'", "''")
        parts.append(f"""p{rank} AS (
  SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(t, '{quoted}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS ps FROM d)
), s{rank} AS (
  SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p{rank}
)""")
        measured = f"regexp_extract(p, '{quoted}', {group})" if group else "p"
        spans.append(f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - length(p) AS s, e FROM s{rank} WHERE i % 2 = 0 AND length({measured}) >= {least}")
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents), {", ".join(parts)},
sp AS ({" UNION ALL ".join(spans)}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
  FROM sp GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


OP3 = _op3()
