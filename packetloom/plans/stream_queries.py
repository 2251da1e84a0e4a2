"""Queries that run the transport engine itself: raw packets built from events, and streams over the events' files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import packet
from packetloom.operators import detect, seq, summary
from packetloom.plans import relational
from packetloom.session import read_table
from packetloom.streaming import live

QUERIES: dict[str, relational.Query] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def raw_packets(spark, d) -> DataFrame:
    """Whole packets: those with an adaptation field carry the clock, payloads are filled."""
    p = relational.packets(spark, d)
    bytes_of = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    clock = F.concat(F.lit(bytearray(b"\x07\x10")), bytes_of(F.shiftleft("pcr_base", 15).bitwiseOR(F.lit(0x7E00)), 6))
    field = F.shiftright("header", 5).bitwiseAND(F.lit(1)) == 1
    fill = lambda n: F.lit(bytearray(b"\x55" * n))
    raw = F.concat(bytes_of(F.col("header"), 4), F.when(field, F.concat(clock, fill(176))).otherwise(fill(184)))
    return p.select(F.lit("events").alias("path"), F.col("event_id").alias("packet_index"), (F.col("event_id") * 188).alias("file_offset"), raw.alias("raw"))


def _faults(spark, d) -> DataFrame:
    p = packet.decode(raw_packets(spark, d))
    return detect.union([detect.transport_errors(p), detect.continuity(detect.continuity_rows(p)), detect.pcr_checks(detect.clock_rows(p, "pcr_base"))])


@query
def ts_decode(spark, d):
    p = packet.decode(raw_packets(spark, d))
    return p.select("packet_index", "pid", "cc", "tei", "pusi", "afc", "af_len", "payload_offset", "has_payload", "pcr_base")


@query
def ts_fault_counts(spark, d):
    return _faults(spark, d).groupBy("pid", "severity", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def ts_merged_faults(spark, d):
    return summary.coalesce(_faults(spark, d)).where("type = 'TransportError'").select("pid", "start_packet", "end_packet", "occurrences")


@query
def ts_same_pid_next(spark, d):
    p = packet.decode(raw_packets(spark, d)).where("parse_error is null").withColumn("back", -F.col("packet_index"))
    return seq.scan(p, ["path", "pid"], "back", lags={"next_index": F.col("packet_index")}).select("packet_index", "pid", "next_index")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """The result table of a stream over finite input, kept in memory: for result tables of bounded size."""
    name = f"live_{uuid.uuid4().hex[:10]}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def event_stream(spark, d) -> DataFrame:
    schema = read_table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    return s.withColumn("at", F.col("ts").cast("timestamp"))


@query
def stream_buckets(spark, d):
    s = event_stream(spark, d).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(s.select(F.floor(F.unix_seconds("w.start") / 86400).alias("day"), "event_type", "n"), "complete")


@query
def stream_continuity(spark, d):
    """Counter faults by keyed state; counters are event numbers modulo 16 within a user's residue class."""
    s = event_stream(spark, d).select(
        F.lit("e").alias("path"), F.pmod("user_id", F.lit(8)).cast("int").alias("pid"), F.col("event_id").alias("packet_index"), F.pmod(F.floor(F.col("event_id") / 8), F.lit(16)).cast("int").alias("cc"), (F.col("event_type") == "error").alias("tei"),
        F.lit(False).alias("discontinuity"), F.lit(True).alias("has_payload"), F.lit(None).cast("string").alias("parse_error"), F.lit(bytearray(188)).alias("raw"))
    return drained(live.continuity(s), "append").select("pid", "packet_index", "fault", "missing")
