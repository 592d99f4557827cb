"""DuckDB SQL of the longer training-data queries, over the tables as they are registered there."""

from __future__ import annotations

from runlens.llm import vector_codes


def vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES,
                     rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Product codes: one set of common table expressions for each round."""
    far = "list_sum(list_transform(list_zip(r.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
cut AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS c
  FROM kept, range({parts}) AS parts(p)),
first AS (SELECT vec_id, min(v) AS v FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e,
         v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS c
  FROM first, range({parts}) AS parts(p))"""]
    for k in range(rounds + 1):
        steps.append(f""",
a{k} AS MATERIALIZED (
  SELECT r.r, r.p, min(({far} * {entries} + b.e)::HUGEINT) AS m FROM cut r JOIN b{k} b USING (p) GROUP BY r.r, r.p)""")
        if k < rounds:
            steps.append(f""",
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT p, e, list(q ORDER BY i) AS c FROM (
      SELECT p, e, i, floor(sum(x) / count(*))::BIGINT AS q FROM (
        SELECT p, m % {entries} AS e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM a{k} JOIN cut USING (r, p))
      GROUP BY p, e, i) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    return "".join(steps) + f""",
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
codes AS (SELECT r, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY p) AS code,
                 sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (r), books"""


#: crc32 by its polynomial 0xEDB88320 (reflected), as the ``crc32`` of Spark and zlib
CONVERSATION_TRIE_SQL = """
WITH RECURSIVE steps(i, n, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS bytes(i) UNION ALL
  SELECT i, n + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE n = 8),
numbered AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS at
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM numbered GROUP BY conv_id), crc),
rebuilt AS (
  SELECT c.conv_id, b.at AS d, b.role, b.text FROM convs c JOIN numbered b ON b.conv_id = c.base AND b.at <= c.h
  UNION ALL
  SELECT c.conv_id, o.at - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text
  FROM convs c JOIN numbered o ON o.conv_id = c.conv_id AND o.at > c.h LEFT JOIN convs b ON b.conv_id = c.base),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, length(text) AS chars,
         list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
nodes AS MATERIALIZED (
  SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, path[1 : any_value(d) - 1] AS up
  FROM prefixes GROUP BY path),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.path = kids.up),
sums AS (SELECT top, sum((n_children = 0)::INT) AS n_leaves, sum((n - 1) * chars) AS saved
         FROM (SELECT unnest(list_transform(range(d + 1), lambda k: path[1 : k])) AS top, n_children, n, chars FROM own) GROUP BY top),
lasts AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
          FROM (SELECT conv_id, arg_max(path, d) AS path FROM prefixes GROUP BY conv_id) GROUP BY path)
SELECT o.conv_id, o.d::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM own o JOIN sums s ON s.top = o.path LEFT JOIN nodes p ON o.d > 0 AND p.path = o.up LEFT JOIN lasts l ON l.path = o.path"""
