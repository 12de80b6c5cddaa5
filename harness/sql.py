"""Common table expressions in the checking engine's SQL, one chain for all queries."""

from __future__ import annotations

from flowtide.schemas import ATTACK_CLASSES, FLOW_FEATURES
from harness.views import P1, SCORE, labelled_expressions, manifest_rows


def rnd(expr: str, digits: int) -> str:
    """The nearest decimal of so many places, from the exact binary value."""
    return f"cast(printf('%.{digits}f', cast({expr} as double)) as double)"


EVENTS = r"""
e as (
  select *, epoch_us(ts) as ts_us, cast(regexp_extract(props, '(\d+)', 1) as bigint) as k, user_id as u
  from events
)"""

CLIENT = "'10.0.' || cast(u // 200 as varchar) || '.' || cast(u % 200 + 1 as varchar)"

PACKETS = f"""
pv as (
  select *, {CLIENT} as c_ip, cast(20000 + u as integer) as c_port,
    '10.1.0.' || cast(u % 7 + 1 as varchar) as s_ip,
    cast(case u % 5 when 0 then 80 when 1 then 443 when 2 then 53 when 3 then 22 else 8080 end as integer) as s_port,
    (event_type in ('signup', 'view') or (event_type in ('click', 'error') and event_id % 3 <> 0)) as out
  from e
),
pk as (
  select event_id as pkt_id, ts_us,
    case when out then c_ip else s_ip end as src_ip, case when out then s_ip else c_ip end as dst_ip,
    case when out then c_port else s_port end as src_port, case when out then s_port else c_port end as dst_port,
    case when u % 5 = 2 then 'udp' else 'tcp' end as proto,
    cast(40 + floor(value) as bigint) as length, case when out then 64 else 60 end as ttl,
    event_type in ('signup', 'purchase') as syn, event_type in ('view', 'click', 'purchase') as ack,
    event_type = 'click' and k % 10 = 0 as fin, event_type = 'error' and k % 4 = 0 as rst,
    event_type = 'click' as psh, false as urg,
    1000 + k as tcp_seq, 1024 * (k % 4) as tcp_window
  from pv
)"""


def segments(p: tuple[float, float]) -> str:
    gap, active = int(p[0] * 1e6), int(p[1] * 1e6)
    return f"""
pkk as (
  select *, fin or rst as ends,
    least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' ||
    greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' || proto as key
  from pk
),
wk as (select *, row_number() over (partition by key order by ts_us, pkt_id) as rn from pkk),
walk as (
  select key, rn, ts_us, ends, ts_us as start_us, 1 as flow_no from wk where rn = 1
  union all
  select p.key, p.rn, p.ts_us, p.ends,
    case when w.ends or w.ts_us - w.start_us >= {active} or p.ts_us - w.ts_us >= {gap} then p.ts_us else w.start_us end,
    w.flow_no + case when w.ends or w.ts_us - w.start_us >= {active} or p.ts_us - w.ts_us >= {gap} then 1 else 0 end
  from walk w join wk p on p.key = w.key and p.rn = w.rn + 1
),
s1 as (
  select wk.*, walk.flow_no, row_number() over fo as pos,
    first_value(src_ip) over fo as f_ip, first_value(src_port) over fo as f_port
  from wk join walk using (key, rn)
  window fo as (partition by wk.key, walk.flow_no order by wk.ts_us, wk.pkt_id)
),
s2 as (select *, src_ip = f_ip and src_port = f_port as fwd from s1),
s3 as (
  select *, ts_us - lag(ts_us) over (partition by key, flow_no, fwd order by pos) as gap_us,
    coalesce(max(case when not fwd and syn and ack then 1 else 0 end) over (
      partition by key, flow_no order by pos rows between unbounded preceding and 1 preceding), 0) as sa_before
  from s2
),
s4 as (
  select *, abs(gap_us - lag(gap_us) over (partition by key, flow_no, fwd order by pos)) as jitter_us,
    sum(case when fwd and ack and sa_before = 1 then 1 else 0 end) over (partition by key, flow_no order by pos) as n_ans
  from s3
),
seg as (
  select *, fwd and ack and sa_before = 1 and n_ans = 1 as first_answer,
    case when fin then 'FIN' when rst then 'RST' when fwd and syn and not ack then 'REQ'
      when fwd and ack and sa_before = 1 and n_ans = 1 then 'CON' when not fwd and syn and ack then 'ACC' end as new_state
  from s4
)"""


def flows(p: tuple[float, float]) -> str:
    gap, active = int(p[0] * 1e6), int(p[1] * 1e6)
    side = ",\n    ".join(
        f"""count(*) filter ({c}) as {x}pkts, coalesce(sum(length) filter ({c}), 0)::bigint as {x}bytes,
    coalesce(arg_max(ttl, pos) filter ({c}), 0) as {x}ttl,
    coalesce(arg_min(tcp_window, pos) filter ({c} and tcp_window > 0), 0) as {x}win,
    coalesce(arg_min(tcp_seq, pos) filter ({c} and tcp_seq > 0), 0) as {x}tcpb,
    count(*) filter ({c} and tcp_seq > 0) - count(distinct tcp_seq) filter ({c} and tcp_seq > 0) as {x}loss,
    coalesce(cast(sum(gap_us) filter ({c}) as double) / nullif(count(gap_us) filter ({c}), 0), 0.0) as {x}gap,
    coalesce(cast(sum(jitter_us) filter ({c}) as double) / nullif(count(jitter_us) filter ({c}), 0), 0.0) as {x}jitter"""
        for x, c in (("s", "fwd"), ("d", "not fwd"))
    )
    flags = ", ".join(f"count(*) filter ({f}) as {f}_n" for f in ("syn", "ack", "fin", "rst", "psh", "urg"))
    rounded = {
        "dur": ("dur0", 6), "rate": ("(spkts + dpkts) / dur0", 4), "sload": ("sbytes * 8.0::double / dur0", 4),
        "dload": ("dbytes * 8.0::double / dur0", 4), "sinpkt": ("sgap / 1e3", 4), "dinpkt": ("dgap / 1e3", 4),
        "sjit": ("sjitter / 1e3", 4), "djit": ("djitter / 1e3", 4), "tcprtt": ("(sa + ad) / 1e3", 4),
        "synack": ("sa / 1e3", 4), "ackdat": ("ad / 1e3", 4),
        "smean": ("case when spkts = 0 then 0.0 else sbytes::double / spkts end", 2),
        "dmean": ("case when dpkts = 0 then 0.0 else dbytes::double / dpkts end", 2),
        "pkt_size_var": (
            "case when spkts + dpkts > 1 then cast((spkts + dpkts)::hugeint * size_sq - size_sum::hugeint * size_sum as double)"
            " / cast((spkts + dpkts) * (spkts + dpkts - 1) as double) else 0.0 end", 2,
        ),
        **{f"{f}_ratio": (f"{f}_n::double / greatest(syn_n + ack_n + fin_n + rst_n + psh_n + urg_n, 1)", 4)
           for f in ("syn", "ack", "fin", "rst")},
    }
    return f"""
fa as (
  select key, flow_no, arg_min(pkt_id, pos) as opener, any_value(f_ip) as src_ip, any_value(f_port) as src_port,
    any_value(case when fwd then dst_ip else src_ip end) as dst_ip,
    any_value(case when fwd then dst_port else src_port end) as dst_port, any_value(proto) as proto,
    min(ts_us) as start_us, max(ts_us) as last_us, arg_max(ends, pos) as ended,
    {side},
    sum(length)::bigint as size_sum, sum(length * length)::hugeint as size_sq,
    arg_max(ts_us, pos) filter (fwd and syn and not ack) as syn_us,
    arg_max(ts_us, pos) filter (not fwd and syn and ack) as synack_us,
    min(ts_us) filter (first_answer) as ack_us,
    coalesce(arg_max(new_state, pos) filter (new_state is not null), 'REQ') as state, {flags}
  from seg group by key, flow_no
),
fb as (
  select *, greatest(0.0001::double, (last_us - start_us) / 1e6) as dur0,
    coalesce(greatest(0, synack_us - syn_us), 0) as sa, coalesce(greatest(0, ack_us - synack_us), 0) as ad,
    case when ended or last_us - start_us >= {active} then last_us else last_us + {gap} end as close_us
  from fa
),
fl as (
  select src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || '_' || proto as flow_id,
    {iso("last_us")} as "timestamp", src_ip, dst_ip, src_port, dst_port, proto,
    case least(src_port, dst_port) when 80 then 'http' when 443 then 'ssl' when 53 then 'dns' when 22 then 'ssh'
      when 21 then 'ftp' when 25 then 'smtp' when 110 then 'pop3' when 143 then 'imap' else '-' end as service,
    state, spkts, dpkts, sbytes, dbytes, sttl, dttl, sloss, dloss, swin, dwin, stcpb, dtcpb,
    {", ".join(f"{rnd(x, d)} as {n}" for n, (x, d) in rounded.items())},
    syn_n, ack_n, fin_n, rst_n, psh_n, urg_n, flow_no, opener, start_us, last_us, close_us
  from fb
)"""


def iso(us: str) -> str:
    ts = f"make_timestamp({us})"
    return (
        f"case when {us} % 1000000 = 0 then strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00') "
        f"else strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f+00:00') end"
    )


_MATCH = {
    "ct_srv_src": "src_ip, service", "ct_state_ttl": "state, sttl", "ct_dst_ltm": "dst_ip",
    "ct_src_dport_ltm": "src_ip, dst_port", "ct_dst_sport_ltm": "dst_ip, src_port", "ct_dst_src_ltm": "src_ip, dst_ip",
}
_MATCH_EXT = {"ct_src_ltm": "src_ip", "ct_srv_dst": "dst_ip, service"}


def _counts(match: dict[str, str]) -> str:
    return ", ".join(
        f"1 + count(*) over (partition by {c} order by seq range between 100 preceding and 1 preceding) as {n}"
        for n, c in match.items()
    )


CONTEXT = f"""
sq as (select *, row_number() over (order by close_us, start_us, flow_id, flow_no) - 1 as seq from fl),
rec as (select *, {_counts(_MATCH)} from sq)"""
CONTEXT_EXT = f"""
sq as (select *, row_number() over (order by close_us, start_us, flow_id, flow_no) - 1 as seq from fl),
rec as (select *, {_counts(_MATCH_EXT)}, cast(src_ip = dst_ip and src_port = dst_port as integer) as is_sm_ips_ports from sq)"""

LABELLED = (
    "lf as (select " + ", ".join(f"{x} as {n}" for n, x in labelled_expressions().items())
    + f", {SCORE} as p, l_orderkey % 10 < 7 as in_train from lineitem)"
)
CLEAN = """
lc as (
  select * replace (
    trim(proto, e' \\t\\n\\r') as proto,
    case when trim(service, e' \\t\\n\\r') in ('-', '') then 'none' else trim(service, e' \\t\\n\\r') end as service,
    case when trim(state, e' \\t\\n\\r') = '' then 'unknown' else trim(state, e' \\t\\n\\r') end as state)
  from lf
)"""

ALERT_VERSIONS = """
av0 as (select *, ((k * 37) % 100) / 100.0::double as prob from e),
av as (
  select cast(user_id as varchar) as finding_id, event_id as version, ts_us,
    case when event_type = 'signup' then 'New' when event_type in ('view', 'click') then 'Investigating'
      when event_type = 'purchase' then 'Resolved' end as status,
    prob as probability_attack,
    case when prob >= 0.9::double then 'CRITICAL' when prob >= 0.75::double then 'HIGH' when prob >= 0.6::double then 'MEDIUM' else 'LOW' end as severity,
    case when event_type = 'error' then 'note ' || event_id end as analyst_notes,
    '{"proto": "' || case when u % 2 = 0 then 'tcp' else 'udp' end || '", "k": ' || k || '}' as features_summary_json
  from av0
),
cur as (
  select * replace (coalesce(status, 'New') as status) from av
  qualify row_number() over (partition by finding_id order by version desc) = 1
)"""

BLOCKS = f"""
be as (
  select event_id as version, ts_us as created_us, {CLIENT} as target_ip,
    case when event_type = 'error' then 'block' else 'unblock' end as event,
    case when event_type = 'error' then k * 60 end as ttl_seconds
  from e where event_type in ('error', 'signup')
)"""

LATENCY = "lt as (select event_id, ts_us, event_type, value / 1e4 as seconds from e)"


def chain(*ctes: str, final: str) -> str:
    return "with recursive " + ",\n".join(c.strip() for c in ctes) + "\n" + final


def on_packets(final: str) -> str:
    return chain(EVENTS, PACKETS, final=final)


def on_segments(final: str, p: tuple[float, float] = P1) -> str:
    return chain(EVENTS, PACKETS, segments(p), final=final)


def on_flows(final: str, p: tuple[float, float] = P1, more: tuple[str, ...] = ()) -> str:
    return chain(EVENTS, PACKETS, segments(p), flows(p), *more, final=final)


def on_records(final: str, more: tuple[str, ...] = (), p: tuple[float, float] = P1) -> str:
    return chain(EVENTS, PACKETS, segments(p), flows(p), CONTEXT, *more, final=final)


def on_labelled(final: str, more: tuple[str, ...] = ()) -> str:
    return chain(LABELLED, CLEAN, *more, final=final)


def on_alerts(final: str, more: tuple[str, ...] = ()) -> str:
    return chain(EVENTS, ALERT_VERSIONS, *more, final=final)


def on_blocks(final: str, more: tuple[str, ...] = ()) -> str:
    return chain(EVENTS, BLOCKS, *more, final=final)


def _tree_case(rows: list[dict], value) -> str:
    """Nested CASE over the node rows of a tree; ``value(leaf, path)`` writes a leaf."""
    nodes = {r["node"]: r for r in rows}

    def at(n: int, path: tuple) -> str:
        r = nodes[n]
        if r["probs"] is not None:
            return value(r, path)
        f = r["feature"]
        left, right = at(r["left"], (*path, (f, -1))), at(r["right"], (*path, (f, 3)))
        return f"case when {f} <= {r['threshold']}::double then {left} else {right} end"

    return at(0, ())


def _model_ctes() -> str:
    rows = manifest_rows()
    trees = [[r for r in rows if r["tree"] == t] for t in (0, 1, 2)]
    names = [c.lower() for c in ATTACK_CLASSES]
    probs = ", ".join(
        "(" + " + ".join(_tree_case(t, lambda leaf, _, i=i: f"{leaf['probs'][i]}::double") for t in trees) + f") / 3.0::double as p_{n}"
        for i, n in enumerate(names)
    )
    steps = ", ".join(
        "(" + " + ".join(
            _tree_case(t, lambda _, path, f=f: str(sum(s for g, s in path if g == f))) for t in trees
        ) + f") as u_{f}"
        for f in ("syn_ratio", "rate", "dur")
    )
    greatest = "greatest(" + ", ".join(f"p_{n}" for n in names) + ")"
    predicted = "case " + " ".join(f"when p_{n} = {greatest} then '{c}'" for n, c in zip(names, ATTACK_CLASSES)) + " end"
    effects = ", ".join(
        f"{{'size': abs({u}), 'place': {i}, 'feature': '{f}', 'units': {u}}}"
        for i, f in enumerate(FLOW_FEATURES)
        for u in [f"u_{f}" if f in ("syn_ratio", "rate", "dur") else "0"]
    )
    return f"""
sc0 as (select *, {probs}, {steps} from rec),
sc as (select *, {predicted} as predicted, 1.0::double - p_normal as anomaly_prob,
  list_reverse_sort([{effects}]) as effects from sc0),
al as (
  select sha256(flow_id || '|' || "timestamp" || '|' || start_us || '|' || opener) as alert_id, "timestamp", flow_id, src_ip, dst_ip, src_port, dst_port,
    proto, case when predicted = 'Normal' then 'Generic' else predicted end as attack_cat, {rnd("anomaly_prob", 4)} as anomaly_prob,
    effects[1].feature as primary_contributing_feature, effects, last_us as created_us,
    case when anomaly_prob >= 0.95::double then 'CRITICAL' else 'HIGH' end as severity, start_us, flow_no, dur, spkts, service
  from sc where anomaly_prob >= 0.85::double
)"""


MODEL = _model_ctes()


def unit_value(units: str) -> str:
    return f"({units} * 0.05::double / 3.0::double)"


def on_scores(final: str, more: tuple[str, ...] = ()) -> str:
    return on_records(final, (MODEL, *more))
