"""SQL counterparts for a second engine, over the same tables."""

from __future__ import annotations

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s0),
s2 AS (SELECT *, (r - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
  coalesce(CAST(sum(cap) OVER b AS BIGINT), 0) AS c, coalesce(CAST(sum(w) OVER b AS BIGINT), 0) AS bw
  FROM s2 WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - c) * w <= cap * (all_w - bw) AS open FROM s3),
s5 AS (SELECT *, total - CAST(sum(CASE WHEN NOT open THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest,
  CAST(sum(CASE WHEN open THEN w ELSE 0 END) OVER () AS BIGINT) AS ow FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN open THEN CAST(rest * w AS DOUBLE) / ow ELSE CAST(cap AS DOUBLE) END AS target FROM s5),
s7 AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM s6),
s8 AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS times FROM s7),
d AS (SELECT z.*, s.source_size, s.target, s.times, s.want - s.times * s.source_size AS part,
  coalesce(CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id, z.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized z JOIN s8 s ON z.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(times * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken
FROM d
"""

OP8 = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
w AS (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS pos FROM l WHERE len(a) >= 3),
v AS (SELECT doc_id, pos, a[pos + 1] || chr(10) || a[pos + 2] || chr(10) || a[pos + 3] AS h FROM w
  WHERE length(trim(a[pos + 1] || a[pos + 2] || a[pos + 3])) > 0),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM v),
c AS (SELECT DISTINCT doc_id, pos + k AS line FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
x AS (SELECT doc_id, text, unnest(a) AS line, unnest(range(0, len(a))) AS pos, len(a) AS n_lines FROM l),
kept AS (SELECT x.doc_id, count(*) FILTER (c.line IS NULL) AS k,
  coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (c.line IS NULL), '') AS text
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.line GROUP BY x.doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.a), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l.a) - k, 0) AS BIGINT) AS n_removed,
  CASE WHEN l.text IS NULL THEN NULL ELSE kept.text END AS text
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""

OP11_LEVELS = 7  # levels of each kind of tree that are written out: 16**7 nodes


def merkle_levels(name: str) -> str:
    """Common table expressions ``<name>1`` and so on above ``<name>0 (g, pos, n, node)``, and their runs of 16."""
    return "".join(f"""
{name}r{k} AS (SELECT g, pos // 16 AS pos, n, string_agg(node, '' ORDER BY pos) AS run FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT g, pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS node FROM {name}r{k}),"""
                   for k in range(OP11_LEVELS))


def merkle_siblings(name: str) -> str:
    """Common table expressions ``<name>p1`` and so on: the proof and the folded node of every row of ``<name>p0``."""
    return "".join(f"""
{name}p{k + 1} AS (SELECT p.* EXCLUDE (proof, fold, place), p.place // 16 AS place,
  CASE WHEN r.n > 1 THEN proof || run[1:(p.place % 16) * 64] || run[(p.place % 16) * 64 + 65:] ELSE proof END AS proof,
  CASE WHEN r.n > 1 THEN sha256(run[1:(p.place % 16) * 64] || fold || run[(p.place % 16) * 64 + 65:]) ELSE fold END AS fold
  FROM {name}p{k} p JOIN {name}r{k} r ON p.g = r.g AND p.place // 16 = r.pos),""" for k in range(OP11_LEVELS))


def merkle_value(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


OP11 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, source, sha256({" || ".join(merkle_value(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
  sha256({" || ".join(merkle_value(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {merkle_value("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc32
  FROM documents, crc),
names AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
x AS (SELECT d.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM d JOIN names ON d.source IS NOT DISTINCT FROM names.source),
a0 AS (SELECT g, pos, n, leaf AS node FROM x),{merkle_levels("a")}
b0 AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, node FROM a{OP11_LEVELS}),{merkle_levels("b")}
ap0 AS (SELECT doc_id, leaf, g, pos AS place, '' AS proof, CASE WHEN crc32 % 5 = 0 THEN changed ELSE leaf END AS fold FROM x),{merkle_siblings("a")}
bp0 AS (SELECT doc_id, leaf, a.node AS subroot, 0 AS g, p.g AS place, proof, fold FROM ap{OP11_LEVELS} p JOIN a{OP11_LEVELS} a ON p.g = a.g),{merkle_siblings("b")}
root AS (SELECT node AS root FROM b{OP11_LEVELS})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM bp{OP11_LEVELS}, root
"""

OP13 = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

SQL: dict[str, str] = {"op3_mixing": OP3, "op8_line_dedup": OP8, "op11_merkle": OP11, "op13_hard_negatives": OP13}
