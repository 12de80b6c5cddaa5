"""Cleaning, contract and profile queries over labelled flows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowtide.functions.columns import round_even
from flowtide.operators import cleaning as cl
from flowtide.operators import profiling as pr
from flowtide.operators.sparse import SparsePreprocessor
from flowtide.schemas import CATEGORICAL, EXPECTED_FEATURES, NUMERIC
from flowtide.session import shared_folder
from flowtide.sources import tables
from harness import views as V
from harness.registry import query
from harness.sql import on_alerts, on_labelled, rnd


def both(spark, sf):
    return V.labelled_flows(spark, sf, "train"), V.labelled_flows(spark, sf, "test")


def quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


_ALL = ["id", *EXPECTED_FEATURES, "attack_cat", "label"]


@query("scan_labelled_flows", on_labelled(f"select {quoted(_ALL)} from lf"))
def _scan(spark, sf):
    path = f"{shared_folder(spark)}/flowtide/labelled-{uuid.uuid4().hex}"
    # The file has another order of columns than the schema, and one more.
    shuffled = sorted(_ALL, key=lambda c: c[::-1])
    tables.write_labelled_flows(V.labelled_flows(spark, sf).select(*shuffled[:9], F.lit("x").alias("extra"), *shuffled[9:]), path)
    return tables.scan_labelled_flows(spark, path).drop(tables.CORRUPT)


@query("clean_categoricals", on_labelled(f"select id, {quoted(CATEGORICAL)} from lc"))
def _clean(spark, sf):
    return cl.clean_categoricals(V.labelled_flows(spark, sf)).select("id", *CATEGORICAL)


@query("split_labels", on_labelled("select id, label, trim(attack_cat) as attack_cat from lf"))
def _labels(spark, sf):
    return cl.split_labels(V.labelled_flows(spark, sf))


@query("drop_leakage", on_labelled(f"select {quoted(EXPECTED_FEATURES)} from lf"))
def _leakage(spark, sf):
    return cl.drop_leakage(V.labelled_flows(spark, sf))


@query("contract_check", on_labelled("select sum(sbytes) as sbytes, count(*) as n from lf"))
def _contract(spark, sf):
    return cl.contract_check(V.labelled_flows(spark, sf)).agg(F.sum("sbytes").alias("sbytes"), F.count(F.lit(1)).alias("n"))


@query("order_columns", on_labelled(f"select {quoted(EXPECTED_FEATURES)} from lc"))
def _order(spark, sf):
    return cl.features_and_labels(V.labelled_flows(spark, sf))[0]


_SHOWN = ["dur", "sbytes", "rate", "swin", "ct_dst_ltm", "is_ftp_login", "is_sm_ips_ports"]


@query("standard_scale", on_labelled(
    "select id, " + ", ".join(rnd(f"(lc.{c} - m_{c}) / s_{c}", 6) + f" as {c}" for c in _SHOWN) + " from lc, st",
    ("st as (select " + ", ".join(
        f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}" for c in _SHOWN
    ) + " from lc where in_train)",),
))
def _scale(spark, sf):
    prep = cl.Preprocessor.fit(V.labelled_flows(spark, sf, "train"))
    cells = prep.scaled()
    rows = cl.clean_categoricals(V.labelled_flows(spark, sf))
    return rows.select("id", *[round_even(cells[c], 6).alias(c) for c in _SHOWN])


_VOCABULARY = {"proto": ["arp", "tcp", "udp"], "service": ["dns", "http", "none"], "state": ["CON", "FIN", "unknown"]}
_HOT = {f"{c}_{v}": (c, v) for c, vs in _VOCABULARY.items() for v in vs}


_STATS = "st as (select " + ", ".join(
    f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}" for c in NUMERIC) + " from lc where in_train)"
_WORDS = "vw as (select c, v, " + f"{len(NUMERIC)} - 1 + row_number() over (order by p, v) as i from (" + " union ".join(
    f"select {k} as p, '{c}' as c, {c} as v from lc where in_train" for k, c in enumerate(CATEGORICAL)) + "))"


@query("matrix_cells", on_labelled(
    f"""select id, i as "index", {rnd("v", 6)} as value from (
  select id, unnest(range({len(NUMERIC)})) as i, unnest([{", ".join(f"(lc.{c} - m_{c}) / s_{c}" for c in NUMERIC)}]) as v from lc, st) where v <> 0
union all """ + " union all ".join(f"select id, i, 1.0::double from lc join vw on vw.c = '{c}' and vw.v = lc.{c}" for c in CATEGORICAL),
    (_STATS, _WORDS),
))
def _cells(spark, sf):
    """Every cell of the matrix that is not zero."""
    prep = SparsePreprocessor.fit(V.labelled_flows(spark, sf, "train"))
    found = prep.cells(V.labelled_flows(spark, sf), ["id"])
    return found.select("id", F.col("index").cast("long").alias("index"), round_even(F.col("value"), 6).alias("value"))


@query("one_hot_ignore", on_labelled("select id, " + ", ".join(
    f"case when {c} = '{v}' then 1.0::double else 0.0::double end as {n}" for n, (c, v) in _HOT.items()) + " from lc"))
def _one_hot(spark, sf):
    prep = cl.Preprocessor.fit(V.labelled_flows(spark, sf, "train"))
    rows = cl.clean_categoricals(V.labelled_flows(spark, sf))
    return rows.select("id", *[e.alias(n) for n, e in prep.one_hot().items()])


@query("assemble_matrix", on_labelled(
    "select id, 48 as width, " + " + ".join(
        f"case when {c} in ({', '.join(repr(v) for v in vs)}) then 1 else 0 end" for c, vs in _VOCABULARY.items()
    ) + f" as ones, {rnd('(lc.dur - m_dur) / s_dur', 6)} as first_value, {rnd('(lc.is_sm_ips_ports - m_last) / s_last', 6)} as last_numeric from lc, st",
    ("""st as (select avg(dur) as m_dur, stddev_pop(dur) as s_dur, avg(is_sm_ips_ports) as m_last, stddev_pop(is_sm_ips_ports) as s_last
  from lc where in_train)""",),
))
def _matrix(spark, sf):
    prep = cl.Preprocessor.fit(V.labelled_flows(spark, sf, "train"))
    n = len(NUMERIC)
    f = F.col("features")
    return prep.transform(V.labelled_flows(spark, sf), ["id"]).select(
        "id", F.size(f).alias("width"),
        F.aggregate(F.slice(f, n + 1, len(prep.names) - n), F.lit(0.0), lambda a, x: a + x).cast("int").alias("ones"),
        round_even(f[0], 6).alias("first_value"), round_even(f[n - 1], 6).alias("last_numeric"),
    )


@query("validate_flow_rows", on_labelled("""
select id, case when dpkts = 3 then null else dur end as dur, sbytes,
  (case when dpkts = 3 then 1 else 0 end + case when spkts = 4 then 1 else 0 end) = 0 as valid,
  case when dpkts = 3 and spkts = 4 then 'dur: invalid;spkts: missing' when dpkts = 3 then 'dur: invalid' when spkts = 4 then 'spkts: missing' else '' end as reasons
from lf"""))
def _validate(spark, sf):
    """Text columns with one kind of unreadable number and one kind of missing value."""
    rows = V.labelled_flows(spark, sf)
    raw = rows.select(
        "id",
        *[
            F.when(F.col("dpkts") == 3, "fast").otherwise(F.col("dur").cast("string")).alias("dur") if c == "dur"
            else F.when(F.col("spkts") != 4, F.col("spkts").cast("string")).alias("spkts") if c == "spkts"
            else F.col(c).cast("string").alias(c)
            for c in EXPECTED_FEATURES
        ],
        F.lit("ignored").alias("extra"),
    )
    checked = cl.validate_rows(raw)
    return checked.select(
        "id", "dur", "sbytes", (F.size("reasons") == 0).alias("valid"), F.array_join("reasons", ";").alias("reasons")
    )


# --- profile ---------------------------------------------------------------------------


@query("schema_parity", """
select coalesce(l.column_name, r.column_name) as "column", l.column_name is not null as in_left, r.column_name is not null as in_right,
  coalesce(l.column_type = r.column_type, false) as same_type
from (describe documents) l full join (describe labels) r on l.column_name = r.column_name""")
def _parity(spark, sf):
    return pr.schema_parity(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"))


@query("null_counts", on_alerts("""
select * from (select 'status' as "column", count(*) - count(status) as nulls from av
  union all select 'analyst_notes', count(*) - count(analyst_notes) from av) where nulls > 0"""))
def _nulls(spark, sf):
    return pr.null_counts(V.alert_events(spark, sf))


@query("inf_counts", on_labelled("""
select 'sload' as "column", count(*) as infs from lf where dpkts = 0 union all select 'dload', count(*) from lf where sttl = 254"""))
def _infs(spark, sf):
    inf = F.lit(float("inf"))
    rows = V.labelled_flows(spark, sf).withColumns(
        {
            "sload": F.when(F.col("dpkts") == 0, inf).otherwise(F.col("sload")),
            "dload": F.when(F.col("sttl") == 254, -inf).otherwise(F.col("dload")),
        }
    )
    return pr.inf_counts(rows)


@query("duplicate_rows", """
select count(*) as n_rows, count(*) - count(distinct (doc_id, text, lang, source, n_chars)) as exact_duplicates,
  count(*) - count(distinct (text, lang, source, n_chars)) as content_duplicates,
  (count(*) - count(distinct (text, lang, source, n_chars)))::double / count(*) as content_share from documents""")
def _duplicates(spark, sf):
    return pr.duplicate_rows(V.table(spark, sf, "documents"), "doc_id")


@query("duplicate_flow_rows", on_labelled(f"""
select (select count(*) from lf) as n_rows, (select count(*) from lf) - (select count(*) from (select distinct {quoted(_ALL)} from lf)) as exact_duplicates,
  (select count(*) from lf) - (select count(*) from (select distinct {quoted(_ALL[1:])} from lf)) as content_duplicates,
  ((select count(*) from lf) - (select count(*) from (select distinct {quoted(_ALL[1:])} from lf)))::double / (select count(*) from lf) as content_share"""))
def _duplicate_flows(spark, sf):
    return pr.duplicate_rows(V.labelled_flows(spark, sf))


_TEXTS = [*CATEGORICAL, "attack_cat"]
_LONG = "vl as (" + " union all ".join(
    f"""select case when in_train then 'train' else 'test' end as split, '{c}' as "column", {c}::varchar as value from lf""" for c in _TEXTS
) + ")"


@query("category_profile", on_labelled("""
select split, "column", count(distinct value) as n_distinct, count(*) filter (value = '-') as n_placeholder,
  count(*) filter (trim(value) = '') as n_blank from vl group by all""", (_LONG,)))
def _profile(spark, sf):
    return pr.category_profile(*both(spark, sf))


@query("unseen_categories", on_labelled("""
select "column", value, min(split) as only_in from (select distinct split, "column", value from vl) group by "column", value having count(*) = 1""", (_LONG,)))
def _unseen(spark, sf):
    return pr.unseen_categories(*both(spark, sf))


@query("target_distribution", on_labelled("""
select split, target, value, count(*) as n, count(*)::double / sum(count(*)) over (partition by split, target) as share from (
  select case when in_train then 'train' else 'test' end as split, unnest(['label', 'attack_cat']) as target, unnest([label::varchar, attack_cat]) as value from lf)
group by split, target, value"""))
def _targets(spark, sf):
    return pr.target_distribution(*both(spark, sf))


@query("label_alignment", on_labelled("select bool_and((attack_cat = 'Normal') = (label = 0)) as aligned from lf"))
def _alignment(spark, sf):
    return pr.label_alignment(V.labelled_flows(spark, sf))


_SHARES = "sh as (" + " union all ".join(
    f"""select '{c}' as "column", max(n)::double / sum(n) as top_share, arg_max(v, n) as top_value
  from (select {c}::varchar as v, count(*) as n from lf group by 1)""" for c in _ALL
) + ")"


@query("constant_columns", on_labelled("""
select "column", top_value, top_share, case when top_share = 1 then 'constant' else 'quasi_constant' end as kind from sh where top_share >= 0.995""", (_SHARES,)))
def _constants(spark, sf):
    return pr.constant_columns(V.labelled_flows(spark, sf))


_STATS = "sm as (" + " union all ".join(
    f"""select '{c}' as "column", min({c}) as "min", max({c}) as "max", median({c}) as median, avg({c}) as mean, stddev_samp({c}) as std from lf"""
    for c in NUMERIC
) + ")"


@query("numeric_summary", on_labelled("""
select "column", "min", "max", median, round(mean, 7) as mean, round(std, 4) as std from sm""", (_STATS,)))
def _summary(spark, sf):
    out = pr.numeric_summary(V.labelled_flows(spark, sf))
    return out.withColumns({"mean": F.round("mean", 7), "std": F.round("std", 4)})


@query("dynamic_range", on_labelled("""
select "column", round("max" / (median + 1e-6), 3) as spread from sm where "max" > 0 and "min" >= 0 and "max" / (median + 1e-6) > 20""", (_STATS,)))
def _range(spark, sf):
    out = pr.dynamic_range(pr.numeric_summary(V.labelled_flows(spark, sf)), limit=20.0)
    return out.withColumn("spread", F.round("spread", 3))


@query("report_json", on_labelled("""
select count(*) filter (in_train) as train_rows, count(*) filter (not in_train) as test_rows, 45 as columns_count, true as schema_match,
  (select count(*) from sh where top_share >= 0.995) as n_constant from lf""", (_SHARES,)))
def _report(spark, sf):
    path = f"{shared_folder(spark)}/flowtide/report-{uuid.uuid4().hex}"
    tables.write_report(pr.profile_report(*both(spark, sf)), path)
    return spark.read.json(path).select(
        "train_rows", "test_rows", "columns_count", "schema_match",
        F.size("constant_columns").alias("n_constant"),
    )


