"""Packet-level operators: header normalisation, one-way counters, block-list filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import count_when
from flowtide.schemas import FLAGS, PROTOCOL_NUMBERS


def normalise_packets(headers: DataFrame) -> DataFrame:
    """Decoded header columns to packets.

    Input: ``ip_version, proto_num, sport, dport, flags, ...``. Rows that are not IP are dropped, ports
    exist only for TCP and UDP, and the TCP flag letters become boolean columns.
    """
    number = F.col("proto_num")
    proto = F.concat(F.lit("proto-"), number.cast("string"))
    for value, name in PROTOCOL_NUMBERS.items():
        proto = F.when(number == value, F.lit(name)).otherwise(proto)
    has_ports = F.col("proto").isin("tcp", "udp")
    is_tcp = F.col("proto") == "tcp"
    flags = {
        name: is_tcp & F.coalesce(F.contains(F.col("flags"), F.lit(name[0].upper())), F.lit(False))
        for name in FLAGS
    }
    return (
        headers.filter(F.col("ip_version").isNotNull())
        .withColumn("proto", proto)
        .withColumns(
            {
                "src_port": F.when(has_ports, F.col("sport")).otherwise(F.lit(0)).cast("int"),
                "dst_port": F.when(has_ports, F.col("dport")).otherwise(F.lit(0)).cast("int"),
                "tcp_seq": F.when(is_tcp, F.col("tcp_seq")).otherwise(F.lit(0)).cast("long"),
                "tcp_window": F.when(is_tcp, F.col("tcp_window")).otherwise(F.lit(0)).cast("long"),
                **flags,
            }
        )
        .drop("ip_version", "proto_num", "sport", "dport", "flags")
    )


def one_way_counters(packets: DataFrame) -> DataFrame:
    """Counters per one-way 5-tuple; other protocols are keyed with zero ports."""
    has_ports = F.col("proto").isin("tcp", "udp")
    is_tcp = F.col("proto") == "tcp"
    return (
        packets.withColumns(
            {
                "src_port": F.when(has_ports, F.col("src_port")).otherwise(F.lit(0)),
                "dst_port": F.when(has_ports, F.col("dst_port")).otherwise(F.lit(0)),
            }
        )
        .groupBy("src_ip", "dst_ip", "src_port", "dst_port", "proto")
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.sum("length").alias("bytes"),
            F.min("ts_us").alias("first_seen_us"),
            F.max("ts_us").alias("last_seen_us"),
            *[count_when(is_tcp & F.col(f)).alias(f"{f}_count") for f in ("syn", "ack", "fin", "rst")],
        )
    )


def drop_blocked(packets: DataFrame, blocked: DataFrame) -> DataFrame:
    """Drop packets whose source is on the block list (``target_ip``).

    No broadcast is forced: the list may be long, and Spark picks the join by its measured size.
    """
    ips = blocked.select(F.col("target_ip").alias("src_ip")).distinct()
    return packets.join(ips, "src_ip", "left_anti")
