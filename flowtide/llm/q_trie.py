"""op11: the prefix trie of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import conversation_trie
from flowtide.llm.common import table
from flowtide.llm.queries import query

# crc32 of the decimal conv_id, bit by bit: eight steps for each byte.
_CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295::bigint], list_transform(string_split(cast(c as varchar), ''), lambda k: cast(ascii(k) as bigint))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL = rf"""
with turns as (
  select conv_id c, coalesce(role, '') r, coalesce(text, '') x, turn from conversations where conv_id is not null),
own as (
  select c, list({{'r': r, 'x': x}} order by turn nulls first, sha256(strlen(r) || ':' || r || x)) ts from turns group by c),
rebuilt as (
  select o.c, list_concat(coalesce(b.ts, [])[1:h], o.ts[h + 1:]) s
  from (select *, {_CRC} % 4 h from own) o left join own b on b.c = o.c - o.c % 20),
members as (select c, s, d, s[1:d] p from rebuilt, unnest(range(0, len(s) + 1)) as u(d)),
nodes as (
  select d, p, min(c) id, count(*) n, string_agg(cast(c as varchar), ',' order by c) filter (len(s) = d) ends,
         case when d > 0 then len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) else 0 end w
  from members group by d, p),
edges as (select d - 1 d, p[1:d - 1] p, count(*) k from nodes where d > 0 group by all),
grown as (select n.*, coalesce(k, 0) k from nodes n left join edges using (d, p)),
sums as (
  select a, p[1:a] p, sum(case when k = 0 then 1 else 0 end) leaves, sum((n - 1) * w) saved
  from grown, unnest(range(0, d + 1)) as u(a) group by all)
select g.id conv_id, g.d depth, up.id parent_conv_id, g.n n_convs, cast(g.k as bigint) n_children,
       cast(s.leaves as bigint) n_leaves, cast(s.saved as bigint) saved_tokens, sha256(coalesce(g.ends, '')) ends_sha256
from grown g join sums s on s.a = g.d and s.p = g.p left join nodes up on up.d = g.d - 1 and up.p = g.p[1:g.d - 1] and g.d > 0
"""


@query("op11_conversation_trie", SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))
