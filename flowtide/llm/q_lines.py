"""op4: documents without repeated runs of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import line_dedup
from flowtide.llm.common import table
from flowtide.llm.queries import query

SQL = r"""
with rows as (
  select doc_id, text, string_split(text, chr(10)) ls, row_number() over (order by doc_id) rid from documents),
lines as (
  select rid, unnest(ls) x, unnest(range(len(ls))) i from rows where text is not null and text <> ''),
full_lines as (
  select rid, i, trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') x from lines
  where trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''),
placed as (select *, row_number() over (partition by rid order by i) p from full_lines),
runs as (
  select a.rid, a.p, a.i i1, b.i i2, row_number() over (partition by a.x, b.x order by a.rid, a.p) nth
  from placed a join placed b on a.rid = b.rid and b.p = a.p + 1),
singles as (
  select rid, i, row_number() over (partition by x order by rid, p) nth from placed
  where len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 50),
gone as (
  select rid, i1 i from runs where nth > 1 union select rid, i2 from runs where nth > 1 union select rid, i from singles where nth > 1),
kept as (
  select l.rid, string_agg(x, chr(10) order by l.i) t, count(*) n
  from lines l left join gone g on l.rid = g.rid and l.i = g.i where g.i is null group by l.rid),
counts as (select rid, count(*) n from gone group by rid)
select doc_id, case when coalesce(text, '') = '' then 0 else len(ls) end n_lines, coalesce(c.n, 0) n_removed,
       length(case when c.n is null then coalesce(text, '') else coalesce(t, '') end) n_chars,
       md5(case when c.n is null then coalesce(text, '') else coalesce(t, '') end) text_md5
from rows left join kept using (rid) left join counts c using (rid)
"""


@query("op4_line_dedup", SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5")
    )
