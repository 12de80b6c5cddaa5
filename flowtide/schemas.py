"""Column contracts and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: they must equal the published contract for right results ---------

# Features of one flow in scoring order.
FLOW_FEATURES = [
    "dur", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl", "sload", "dload",
    "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "stcpb", "dtcpb", "dwin",
    "tcprtt", "synack", "ackdat", "smean", "dmean", "pkt_size_var", "syn_ratio", "ack_ratio",
    "fin_ratio", "rst_ratio", "ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm",
    "ct_dst_sport_ltm", "ct_dst_src_ltm",
]
FLOW_IDENTITY = [
    "flow_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "service", "state",
]
CONTEXT_COUNTS = FLOW_FEATURES[-6:]
ATTACK_CLASSES = ["Normal", "DoS", "Exploits", "Reconnaissance", "Fuzzers", "Generic"]

# Columns of the labelled flow table.
CATEGORICAL = ["proto", "service", "state"]
NUMERIC = [
    "dur", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl", "sload", "dload",
    "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "stcpb", "dtcpb", "dwin",
    "tcprtt", "synack", "ackdat", "smean", "dmean", "trans_depth", "response_body_len",
    "ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd", "ct_src_ltm",
    "ct_srv_dst", "is_sm_ips_ports",
]
EXPECTED_FEATURES = CATEGORICAL + NUMERIC
TARGET, TARGET_CLASS, ROW_ID = "label", "attack_cat", "id"

SERVICE_PORTS = {
    80: "http", 443: "ssl", 53: "dns", 22: "ssh", 21: "ftp", 25: "smtp", 110: "pop3", 143: "imap",
}
PROTOCOL_NUMBERS = {6: "tcp", 17: "udp", 1: "icmp"}
CLASSTYPES = {
    "DoS": "denial-of-service",
    "Exploits": "attempted-admin",
    "Reconnaissance": "network-scan",
    "Fuzzers": "misc-activity",
    "Generic": "bad-traffic",
    "Normal": "not-suspicious",
}
# (hits, seconds) per source that count as an attack of the category.
RATE_LIMITS = {"DoS": (50, 5), "Reconnaissance": (20, 10)}
LATENCY_BOUNDS = [0.0001, 0.00025, 0.0005, 0.001, 0.002, 0.005, 0.010, 0.025, 0.050, 0.1, float("inf")]
STATUSES = ["New", "Investigating", "Resolved"]
SEVERITIES = ["INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
EVIDENCE = ["proto", "service", "state", "dur", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl"]
ALERT_CSV_COLUMNS = [
    "finding_id", "timestamp", "prediction", "label", "probability_attack", "confidence",
    "severity", "status", "model_name", "analyst_notes", "updated_at",
]

FLOW_TIMEOUT_S = 15.0
ACTIVE_TIMEOUT_S = 60.0
MIN_DURATION_S = 0.0001
HISTORY = 100
ANOMALY_THRESHOLD = 0.85
CRITICAL_THRESHOLD = 0.95
DETECTION_THRESHOLD = 0.5
BLOCK_TTL_S = 3600
BASE_SID = 1000001
TOP_CONTRIBUTORS = 3
STEP_UP, STEP_DOWN = 0.15, -0.05
QUASI_CONSTANT = 0.995
DYNAMIC_RANGE = 1000.0

# --- schemas -------------------------------------------------------------------------

FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]

PACKET = T.StructType(
    [
        T.StructField("pkt_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("ttl", T.IntegerType()),
        *[T.StructField(f, T.BooleanType()) for f in FLAGS],
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_window", T.LongType()),
    ]
)

_COUNTS = {
    "spkts", "dpkts", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "swin", "stcpb",
    "dtcpb", "dwin", *CONTEXT_COUNTS,
}
FLOW = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c.endswith("_port") else T.StringType())
        for c in FLOW_IDENTITY
    ]
    + [
        T.StructField(c, T.LongType() if c in _COUNTS else T.DoubleType())
        for c in FLOW_FEATURES
    ]
)

LABELLED_FLOW = T.StructType(
    [T.StructField(ROW_ID, T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    + [T.StructField(TARGET_CLASS, T.StringType()), T.StructField(TARGET, T.IntegerType())]
)

# One row per tree node; a leaf has probs and null feature / children.
ENSEMBLE_NODE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("probs", T.ArrayType(T.DoubleType())),
    ]
)

EVIDENCE_TYPE = T.StructType(
    [T.StructField(c, T.StringType() if c in CATEGORICAL else T.DoubleType()) for c in EVIDENCE]
)

ALERT = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("probability_attack", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("is_alert", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("threshold_used", T.DoubleType()),
        T.StructField("features_summary_json", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("analyst_notes", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("version", T.LongType()),
    ]
)
