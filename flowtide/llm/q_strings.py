"""op12: documents without the byte strings that earlier ones hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import bwt_dedup
from flowtide.llm.common import table
from flowtide.llm.queries import query

# Bytes as hex digits, cut into blocks first: a string function on a long text would cost its length for every start.
SQL = """
with docs as (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) h from documents),
sized as (select *, strlen(h) // 2 n from docs),
blocks as (
  select rid, doc_id, n, b, substr(h, 2 * b + 1, 4098) part from (select *, unnest(range(0, n - 49, 2000)) b from sized where doc_id is not null)),
strings as (
  select rid, doc_id, b + i s, substr(part, 2 * i + 1, 100) w
  from (select *, unnest(range(0, least(2000, n - 49 - b))) i from blocks)),
first as (select w, min(doc_id) least from strings group by w having count(*) > 1),
gone as (select distinct rid, s from strings join first using (w) where least < doc_id),
cut as (select rid, s, case when s <= lag(s) over (partition by rid order by s) + 50 then 0 else 1 end fresh from gone),
runs as (
  select rid, min(s) a, max(s) + 50 z from (select *, sum(fresh) over (partition by rid order by s) k from cut) group by rid, k),
between_runs as (select *, coalesce(lag(z) over (partition by rid order by a), 0) start from runs),
kept as (
  select rid, sum(z - a) removed, count(*) spans, max(z) last_z, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' order by a) k
  from between_runs join docs using (rid) group by rid)
select doc_id, n n_bytes, cast(coalesce(removed, 0) as bigint) n_removed, coalesce(spans, 0) n_spans,
       sha256(unhex(coalesce(k || substr(h, 2 * last_z + 1), h))) kept_sha256
from sized left join kept using (rid)
"""


@query("op12_string_dedup", SQL)
def op12_string_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes and what stays of every document."""
    return bwt_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
