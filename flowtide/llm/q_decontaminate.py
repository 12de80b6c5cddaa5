"""op5: what of the documents occurs in the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import decontaminate
from flowtide.llm.common import LOWER, UPPER, table
from flowtide.llm.queries import query

_WORDS = (
    rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = f"""
with docs as (select row_number() over () rid, doc_id, {_WORDS} ws from documents),
items as (select cast(item_id as varchar) item, {_WORDS} ws from benchmark),
windows as (
  select distinct item, least(len(ws), 10) n,
         unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) g
  from items where len(ws) > 0),
sizes as (select distinct n from windows),
starts as (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) i from docs, sizes where len(ws) >= n),
hits as (
  select rid, i, n, item
  from (select rid, i, n, array_to_string(ws[i:i+n-1], ' ') g from starts) join windows using (n, g)),
counts as (
  select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hits) group by rid),
named as (
  select rid, count(*) n_items, string_agg(item, ',' order by item) ids
  from (select distinct rid, item from hits where item is not null) group by rid)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join counts using (rid) left join named using (rid)
"""


@query("op5_decontaminate", SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
