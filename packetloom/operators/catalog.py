"""The stream catalog: sections of the information PIDs, and the programs, streams, services and times that they declare.

Sections are assembled per (path, PID) by a fold over the information packets alone, a small share of a stream. A program or stream row
says from which packet on it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import packet, psi

SECTIONS = "path string, pid int, packet_index long, file_offset long, table_id int, bytes binary, crc_ok boolean"
PROGRAMS = "path string, program_number int, pmt_pid int, pcr_pid int, pmt_version int, descriptors binary, packet_index long"
STREAMS = "path string, program_number int, pid int, stream_type_raw int, stream_type int, stream_name string, supplement string, language string, descriptors binary, packet_index long"
SERVICES = "path string, service_id int, name string, provider string, service_type int, sdt_version int, onid int, eit_schedule boolean, eit_pf boolean, running_status int, free_ca boolean, descriptors binary, packet_index long"
TIMES = "path string, packet_index long, file_offset long, utc_seconds double"


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("packet_index")
    tool, last, out = psi.Assembler(), None, []
    for r in rows.itertuples():
        if r.tei or r.parse_error is not None:
            tool.reset()
            last = None
            continue
        if r.discontinuity:
            tool.reset()
            last = None
        if not r.has_payload:
            continue
        if last is not None and r.cc == last:
            continue
        if last is not None and r.cc != (last + 1) & 15:
            tool.reset()
        last = r.cc
        for s in tool.push(bytes(r.raw[r.payload_offset :]), bool(r.pusi)):
            # time tables may come without a checksum
            ok = s[0] == 0x70 or psi.crc32(s) == 0
            out.append((r.path, r.pid, r.packet_index, r.file_offset, s[0], s, ok))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SECTIONS.split(", ")])


def sections(packets: DataFrame, pids: list[int]) -> DataFrame:
    cols = ["path", "pid", "packet_index", "file_offset", "raw", "tei", "parse_error", "discontinuity", "has_payload", "cc", "pusi", "payload_offset"]
    return packets.where(F.col("pid").isin(pids)).select(cols).groupBy("path", "pid").applyInPandas(_fold, SECTIONS)


def _rows(parse: Callable[[object], Iterator[tuple]], schema: str):
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([x for r in f.itertuples() for x in parse(r)], columns=names)

    return run


def _pmt(r) -> dict | None:
    return psi.parse_pmt(bytes(r.bytes)) if r.crc_ok else None


def _programs(r) -> Iterator[tuple]:
    if p := _pmt(r):
        yield r.path, p["program"], r.pid, p["pcr_pid"], p["version"], p["descriptors"], r.packet_index


def _streams(r) -> Iterator[tuple]:
    from packetloom.functions import streams

    for s in (_pmt(r) or {"streams": ()})["streams"]:
        yield r.path, psi.parse_pmt(bytes(r.bytes))["program"], s["pid"], s["raw_type"], s["type"], streams.name_of(s["type"]), s["supplement"], s["language"], s["descriptors"], r.packet_index


def _services(r) -> Iterator[tuple]:
    if r.crc_ok and (t := psi.parse_sdt(bytes(r.bytes))):
        for s in t["services"]:
            yield r.path, s["service_id"], s["name"], s["provider"], s["service_type"], t["version"], t["onid"], s["eit_schedule"], s["eit_pf"], s["running_status"], s["free_ca"], s["descriptors"], r.packet_index


def _times(r) -> Iterator[tuple]:
    if t := psi.parse_time(bytes(r.bytes)):
        yield r.path, r.packet_index, r.file_offset, t.timestamp()


@dataclass
class Catalog:
    """Small tables; ``pat`` is (path, program_number, pmt_pid, packet_index), ``identity`` (path, tsid, pat_version) of each file's last PAT."""

    pat: DataFrame
    programs: DataFrame
    streams: DataFrame
    services: DataFrame
    times: DataFrame
    sections: DataFrame
    identity: DataFrame


def build(packets: DataFrame) -> Catalog:
    """The catalog of decoded packets. Streams are the union over all PMT versions, each from its first packet on.

    Only program numbers and PMT PIDs, at most 8192 a file, come to the driver."""
    pats = sections(packets, [0]).where("crc_ok and table_id = 0").select("path", "packet_index", "bytes")

    def pat_rows(r) -> Iterator[tuple]:
        for number, pid in (psi.parse_pat(bytes(r.bytes)) or {"programs": {}})["programs"].items():
            yield r.path, number, pid, r.packet_index

    def pat_identity(r) -> Iterator[tuple]:
        if t := psi.parse_pat(bytes(r.bytes)):
            yield r.path, t["tsid"], t["version"], r.packet_index

    identity = pats.mapInPandas(_rows(pat_identity, "path, tsid, version, packet_index"), "path string, tsid int, version int, packet_index long")
    identity = identity.groupBy("path").agg(F.max_by("tsid", "packet_index").alias("tsid"), F.max_by("version", "packet_index").alias("pat_version"))
    pat = pats.mapInPandas(_rows(pat_rows, "path, program_number, pmt_pid, packet_index"), "path string, program_number int, pmt_pid int, packet_index long")
    pat = pat.groupBy("path", "program_number", "pmt_pid").agg(F.min("packet_index").alias("packet_index")).persist()
    pmt_pids = [r["pmt_pid"] for r in pat.select("pmt_pid").distinct().collect()]
    every = sections(packets, sorted({0, *packet.SI_PIDS, *pmt_pids})).persist()
    maps = every.join(F.broadcast(pat.select("path", F.col("pmt_pid").alias("pid"), F.col("packet_index").alias("__from"))), ["path", "pid"]).where("table_id = 2 and packet_index > __from").drop("__from")
    first = lambda df, keys: df.groupBy(*keys).agg(F.min("packet_index").alias("packet_index"))
    programs, streams = maps.mapInPandas(_rows(_programs, PROGRAMS), PROGRAMS), maps.mapInPandas(_rows(_streams, STREAMS), STREAMS)
    services = every.where("pid = 17 and table_id = 66").mapInPandas(_rows(_services, SERVICES), SERVICES)
    return Catalog(
        pat, first(programs, programs.columns[:-1]), first(streams, streams.columns[:-1]), first(services, services.columns[:-1]),
        every.where("pid = 20").mapInPandas(_rows(_times, TIMES), TIMES), every, identity,
    )


def latest_streams(c: Catalog) -> DataFrame:
    """The definitions of each program's last PMT version."""
    last = c.programs.groupBy("path", "program_number").agg(F.max("packet_index").alias("__last"))
    return c.streams.join(F.broadcast(last), ["path", "program_number"]).where("packet_index >= __last").drop("__last")


def probe_end(c: Catalog, settle_packets: int, least_packets: int) -> DataFrame:
    """The packet at which a bounded probe may stop: the catalog complete and unchanged for ``settle_packets``."""
    changes = c.pat.select("path", "packet_index").unionByName(c.programs.select("path", "packet_index")).unionByName(c.streams.select("path", "packet_index"))
    missing = c.pat.join(c.programs.select("path", "program_number").distinct(), ["path", "program_number"], "left_anti").select("path").distinct()
    ends = changes.groupBy("path").agg(F.greatest(F.max("packet_index") + settle_packets, F.lit(least_packets)).alias("stop_packet"))
    return ends.join(missing, "path", "left_anti")
