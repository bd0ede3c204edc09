"""op13: the trie of all conversation prefixes, one row for each node."""

from . import prefix_trie
from .common import table
from .registry import query

SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
checksums AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295) % 9 AS h FROM ids),
numbered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
taken AS (
  SELECT k.c, k.h, least(k.h, (SELECT count(*) FROM numbered n WHERE n.c = k.c - k.c % 5)) AS t FROM checksums k),
rebuilt AS (
  SELECT k.c, n.pos AS depth, n.role, n.text FROM taken k JOIN numbered n ON n.c = k.c - k.c % 5 AND n.pos <= k.h
  UNION ALL
  SELECT k.c, n.pos - k.h + k.t, n.role, n.text FROM taken k JOIN numbered n ON n.c = k.c AND n.pos > k.h),
paths AS (
  SELECT c, depth, strlen(text) AS bytes,
    md5(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, 'root' FROM ids),
steps AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY c) AS final FROM paths),
nodes AS (
  SELECT node, min(above) AS above, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE final), '')) AS ends_sha256 FROM steps GROUP BY node),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY 1),
within AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.c = b.c AND a.depth <= b.depth),
sums AS (
  SELECT w.top, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens
  FROM within w JOIN nodes v ON v.node = w.node LEFT JOIN children k ON k.node = w.node GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM nodes v JOIN sums s ON s.top = v.node LEFT JOIN children k ON k.node = v.node LEFT JOIN nodes p ON p.node = v.above
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark, folder):
    return prefix_trie.node_table(table(spark, folder, "conversations"))
