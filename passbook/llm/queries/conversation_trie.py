"""The prefix trie of the rebuilt conversations."""

from passbook.llm.common import table
from passbook.llm.conversation_trie import GROUP, GROUP_TURNS, trie_nodes
from passbook.llm.queries.crc import CRC32, CRC32_TABLE
from passbook.plans.registry import register

SQL = f"""
WITH {CRC32_TABLE},
  t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
      coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
  v AS (
    SELECT c, c - c % {GROUP} AS base, n, {CRC32.format(text="c::VARCHAR")} % {GROUP_TURNS + 1} AS h
    FROM (SELECT c, count(*) AS n FROM t GROUP BY c), crc_table),
  w AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS taken FROM v LEFT JOIN v b ON b.c = v.base),
  r AS (
    SELECT w.c, t.i AS d, role, text FROM w JOIN t ON t.c = w.base AND t.i <= w.taken
    UNION ALL
    SELECT w.c, taken + t.i - h, role, text FROM w JOIN t ON t.c = w.c AND t.i > h),
  p AS (
    SELECT c, d, strlen(text) AS bytes,
      md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM r
    UNION ALL SELECT c, 0, 0, '' FROM w),
  e AS (SELECT arg_max(k, d) AS k, c FROM p GROUP BY c),
  ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM e GROUP BY k),
  node AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY k, d),
  child AS (SELECT a.k, count(DISTINCT b.k) AS n FROM p a JOIN p b ON b.c = a.c AND b.d = a.d + 1 GROUP BY a.k),
  full_node AS (SELECT node.*, coalesce(child.n, 0) AS children FROM node LEFT JOIN child USING (k)),
  under AS (
    SELECT p.k, count(*) FILTER (children = 0) AS leaves, sum((f.n - 1) * f.bytes) AS saved
    FROM full_node f JOIN p ON p.c = f.c AND p.d <= f.d GROUP BY p.k)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_node f JOIN under USING (k) LEFT JOIN ends USING (k)
  LEFT JOIN p ON p.c = f.c AND p.d = f.d - 1 LEFT JOIN node u ON u.k = p.k"""


@register("op13_conversation_trie", SQL)
def op13_conversation_trie(spark, sf_dir):
    return trie_nodes(table(spark, sf_dir, "conversations"))
