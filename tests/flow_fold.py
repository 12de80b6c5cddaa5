"""A plain fold over packets, written from the definitions, to check the flow operators."""

from dataclasses import dataclass, field


@dataclass
class Open:
    src: tuple
    dst: tuple
    proto: str
    start: int
    last: int
    state: str = "REQ"
    sides: dict = field(default_factory=lambda: {True: [], False: []})
    syn: int | None = None
    synack: int | None = None
    ack: int | None = None
    flags: dict = field(default_factory=dict)


FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")


def fold(packets, gap_us, active_us):
    """packets: dicts of one table. Returns a list of flow dicts."""
    by_key = {}
    for p in sorted(packets, key=lambda p: (p["ts_us"], p["pkt_id"])):
        a, b = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        by_key.setdefault((min(a, b), max(a, b), p["proto"]), []).append(p)
    out = []
    for rows in by_key.values():
        flow = None
        for p in rows:
            if flow is not None and p["ts_us"] - flow.last >= gap_us:
                out.append(close(flow, False, gap_us))
                flow = None
            if flow is None:
                flow = Open((p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"]), p["proto"], p["ts_us"], p["ts_us"])
            add(flow, p)
            if p["fin"] or p["rst"] or p["ts_us"] - flow.start >= active_us:
                out.append(close(flow, True, gap_us))
                flow = None
        if flow is not None:
            out.append(close(flow, False, gap_us))
    return out


def add(f, p):
    fwd = (p["src_ip"], p["src_port"]) == f.src
    f.last = max(f.last, p["ts_us"])
    f.sides[fwd].append(p)
    if fwd:
        if p["syn"] and not p["ack"]:
            f.syn, f.state = p["ts_us"], "REQ"
        elif p["ack"] and f.synack is not None and f.ack is None:
            f.ack, f.state = p["ts_us"], "CON"
    elif p["syn"] and p["ack"]:
        f.synack, f.state = p["ts_us"], "ACC"
    for name in FLAGS:
        f.flags[name] = f.flags.get(name, 0) + bool(p[name])
    if p["fin"]:
        f.state = "FIN"
    elif p["rst"]:
        f.state = "RST"


def close(f, by_packet, gap_us):
    r = {
        "src_ip": f.src[0], "src_port": f.src[1], "dst_ip": f.dst[0], "dst_port": f.dst[1], "proto": f.proto,
        "start_us": f.start, "last_us": f.last, "close_us": f.last if by_packet else f.last + gap_us,
        "state": f.state,
    }
    for side, fwd in (("s", True), ("d", False)):
        ps = f.sides[fwd]
        times = [p["ts_us"] for p in ps]
        gaps = [y - x for x, y in zip(times, times[1:])]
        jit = [abs(y - x) for x, y in zip(gaps, gaps[1:])]
        seqs = [p["tcp_seq"] for p in ps if p["tcp_seq"] > 0]
        r[f"{side}pkts"] = len(ps)
        r[f"{side}bytes"] = sum(p["length"] for p in ps)
        r[f"{side}ttl"] = ps[-1]["ttl"] if ps else 0
        r[f"{side}win"] = next((p["tcp_window"] for p in ps if p["tcp_window"] > 0), 0)
        r[f"{side}tcpb"] = next((p["tcp_seq"] for p in ps if p["tcp_seq"] > 0), 0)
        r[f"{side}loss"] = len(seqs) - len(set(seqs))
        r[f"{side}inpkt"] = sum(gaps) / len(gaps) / 1e3 if gaps else 0.0
        r[f"{side}jit"] = sum(jit) / len(jit) / 1e3 if jit else 0.0
        r[f"{side}mean"] = sum(p["length"] for p in ps) / len(ps) if ps else 0.0
    sizes = [p["length"] for fwd in (True, False) for p in f.sides[fwd]]
    n, mean = len(sizes), sum(sizes) / len(sizes)
    r["pkt_size_var"] = sum((x - mean) ** 2 for x in sizes) / (n - 1) if n > 1 else 0.0
    r["synack"] = max(0, f.synack - f.syn) / 1e3 if f.syn is not None and f.synack is not None else 0.0
    r["ackdat"] = max(0, f.ack - f.synack) / 1e3 if f.synack is not None and f.ack is not None else 0.0
    r["tcprtt"] = r["synack"] + r["ackdat"]
    r["dur"] = max(0.0001, (f.last - f.start) / 1e6)
    r["rate"] = n / r["dur"]
    r["sload"], r["dload"] = r["sbytes"] * 8 / r["dur"], r["dbytes"] * 8 / r["dur"]
    total = sum(f.flags.values()) or 1
    for name in ("syn", "ack", "fin", "rst"):
        r[f"{name}_ratio"] = f.flags[name] / total
    return r
