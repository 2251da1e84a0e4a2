"""Edits of packet streams as plans over decoded packets: filter, split, remap, cut, merge, extract.

Results are rows (packet_index, sub_index, raw) whose order is that of the output file; :func:`packetloom.sources.mpegts.write` writes them. Media packets
stay in the JVM; only information packets and packets with clocks go through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import packet, psi, synth
from packetloom.operators import seq

MASK = (1 << 33) - 1
OUT = "packet_index long, sub_index int, raw binary"


def with_header(raw: Column, header: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(header), 8, "0")), F.substring(raw, 5, 184))


def renumbered(header: Column, pid: Column | None = None, cc: Column | None = None) -> Column:
    """A header word with another PID and counter."""
    if pid is not None:
        header = header.bitwiseAND(F.lit(~(0x1FFF << 8))).bitwiseOR(F.shiftleft(pid.cast("long"), 8))
    return header if cc is None else header.bitwiseAND(F.lit(~15)).bitwiseOR(cc.cast("long"))


def _plain(p: DataFrame) -> DataFrame:
    return p.select("packet_index", F.lit(0).alias("sub_index"), "raw")


def _tables(p: DataFrame, sections: dict[int, bytes]) -> DataFrame:
    """Each start packet of an information PID gives way to the packets of its new section; counters run on per PID."""
    marks = p.where(F.col("pid").isin(list(sections)) & F.col("pusi") & ~F.col("tei")).select("path", "pid", "packet_index")
    marks = seq.scan(marks, ["path", "pid"], "packet_index", sums={"nth": F.lit(1).cast("long")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                n = -(-(len(sections[r.pid]) + 1) // 184)
                out += [(r.packet_index, i, x) for i, x in enumerate(psi.packetize(sections[r.pid], r.pid, (r.nth - 1) * n & 15))]
            yield pd.DataFrame(out, columns=["packet_index", "sub_index", "raw"])

    return marks.mapInPandas(run, OUT)


def _clock_only(p: DataFrame, pids: list[int], cc: int | None = None) -> DataFrame:
    """Packets of clock carriers whose payload is not wanted: the clock alone, with its counter (or a fixed one)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raws = [synth.packet(r.pid, r.cc if cc is None else cc, b"", pcr=r.pcr_base, disc=r.discontinuity, afc=2) for r in f.itertuples()]
            yield pd.DataFrame({"packet_index": f.packet_index, "sub_index": 0, "raw": raws})

    rows = p.where(F.col("pid").isin(pids) & F.col("pcr_base").isNotNull() & ~F.col("tei"))
    return rows.select("pid", "cc", "pcr_base", "discontinuity", "packet_index").mapInPandas(run, OUT)


def _programs(c, path: str | None = None) -> tuple[list, list]:
    programs = c.programs if path is None else c.programs.where(F.col("path") == path)
    latest = programs.groupBy("program_number").agg(F.max_by(F.struct("pmt_pid", "pcr_pid", "pmt_version", "descriptors"), "packet_index").alias("p")).select("program_number", "p.*").collect()
    streams = c.streams.groupBy("program_number", "pid").agg(F.max_by(F.struct("stream_type_raw", "descriptors"), "packet_index").alias("s")).select("program_number", "pid", "s.*").collect()
    return sorted(latest, key=lambda r: r.program_number), sorted(streams, key=lambda r: (r.program_number, r.pid))


def _pat(c, programs: dict[int, int]) -> bytes:
    """A PAT under the source's stream id, its version one further, programs in order of number."""
    own = c.identity.orderBy("path").first()
    return psi.build_pat(own["tsid"] if own else 1, ((own["pat_version"] if own else 0) + 1) % 32, dict(sorted(programs.items())))


def filter_streams(p: DataFrame, c, selected: set[int], service_information: bool = True) -> DataFrame:
    """Keeps the selected PIDs. PAT and PMTs are rebuilt for programs of which a stream or the PMT is selected; a clock carrier
    that is not selected keeps its clock alone. Plans are as large as the catalog, at most 8192 PIDs."""
    programs, streams = _programs(c)
    kept = [g for g in programs if g.pmt_pid in selected or any(s.pid in selected for s in streams if s.program_number == g.program_number)]
    sections = {0: _pat(c, {g.program_number: g.pmt_pid for g in kept})}
    for g in kept:
        entries = [(s.stream_type_raw, s.pid, bytes(s.descriptors)) for s in streams if s.program_number == g.program_number and s.pid in selected]
        sections[g.pmt_pid] = psi.build_pmt(g.program_number, g.pmt_version + 1, g.pcr_pid, entries, bytes(g.descriptors))
    media = (selected | (set(packet.SI_PIDS) if service_information else set())) - set(sections)
    carriers = sorted({g.pcr_pid for g in kept} - media - set(sections))
    return _plain(p.where(F.col("pid").isin(sorted(media)))).unionByName(_tables(p, sections)).unionByName(_clock_only(p, carriers))


def split_services(p: DataFrame, c, services: list[int]) -> DataFrame:
    """One output per service in one pass over the packets: rows of :func:`filter_streams` with ``service_id``."""
    programs, streams = _programs(c)
    out = None
    for g in programs:
        if g.program_number in services:
            own = {s.pid for s in streams if s.program_number == g.program_number}
            part = filter_streams(p, c, own | {g.pmt_pid}).withColumn("service_id", F.lit(g.program_number))
            # a filter on one program's PIDs keeps other programs' PMTs out of its PAT
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no such service")
    return out


def remap(p: DataFrame, c, pids: dict[int, int], services: dict[int, int] | None = None, languages: dict[int, str | None] | None = None, preserve_count: bool = False) -> DataFrame:
    """Packets under new PIDs, with PAT and PMTs rewritten; unmapped media PIDs go, or become null packets if the count is preserved."""
    programs, streams = _programs(c)
    used: set[int] = set()
    for new in pids.values():
        psi.check_output_pid(new, used)
    services, languages = services or {}, languages or {}
    number = lambda n: services.get(n, n)
    kept = [g for g in programs if any(s.pid in pids for s in streams if s.program_number == g.program_number)]
    crypt = p.where(F.col("pid").isin(list(pids)) & F.col("has_payload") & ~F.col("tei") & (F.col("scrambling") >= 2))
    if not crypt.isEmpty():
        raise ValueError("a selected stream is scrambled")
    sections = {0: _pat(c, {number(g.program_number): g.pmt_pid for g in kept})}
    for g in kept:
        entries = [(s.stream_type_raw, pids[s.pid], psi.with_language(bytes(s.descriptors), languages[s.pid]) if s.pid in languages else bytes(s.descriptors)) for s in streams if s.program_number == g.program_number and s.pid in pids]
        sections[g.pmt_pid] = psi.build_pmt(number(g.program_number), g.pmt_version + 1, pids.get(g.pcr_pid, g.pcr_pid), entries, bytes(g.descriptors))
    new = F.create_map(*[F.lit(x) for kv in pids.items() for x in kv])
    media = p.where(F.col("pid").isin(list(pids))).withColumn("raw", with_header(F.col("raw"), renumbered(F.col("header"), F.element_at(new, F.col("pid")))))
    carriers = sorted({g.pcr_pid for g in kept} - set(pids) - set(sections))
    out = _plain(media).unionByName(_tables(p, sections)).unionByName(_clock_only(p, carriers, cc=0))
    if preserve_count:
        null = bytes.fromhex("471fff10") + b"\xff" * 184
        rest = p.select("packet_index").join(out.select("packet_index").distinct(), "packet_index", "left_anti")
        out = out.unionByName(rest.select("packet_index", F.lit(0).alias("sub_index"), F.lit(bytearray(null)).alias("raw")))
    return out


def patch_timestamps(raw: bytes, payload_offset: int, clock: int = 0, stamps: int = 0) -> bytes:
    """A packet whose clock base and timestamps are moved modulo 2**33; the clock's extension and all other bits stay."""
    b = bytearray(raw)
    if b[3] & 0x20 and b[4] >= 7 and b[5] & 0x10:
        v = int.from_bytes(b[6:12], "big")
        b[6:12] = (((v >> 15) + clock & MASK) << 15 | v & 0x7FFF).to_bytes(6, "big")
    o = payload_offset
    if b[1] & 0x40 and b[3] & 0x10 and o + 14 <= 188 and b[o : o + 3] == b"\0\0\1" and b[o + 7] >> 6 >= 2:
        for at in (o + 9, o + 14) if b[o + 7] >> 6 == 3 and o + 19 <= 188 else (o + 9,):
            v = int.from_bytes(b[at : at + 5], "big")
            t = ((v >> 33 & 7) << 30 | (v >> 17 & 0x7FFF) << 15 | v >> 1 & 0x7FFF) + stamps
            b[at : at + 5] = synth.timestamp(v >> 36, t)
    return bytes(b)


def shift_timestamps(p: DataFrame, clock: str, stamps: str) -> DataFrame:
    """``raw`` with clocks moved by the ticks in ``clock`` and timestamps by those in ``stamps``; damaged packets stay. Only packets with clocks meet Python."""
    moved = (F.col("pcr_base").isNotNull() | F.col("pts").isNotNull()) & ~F.col("tei")
    rest = p.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["raw"] = [patch_timestamps(bytes(r), int(o), int(c), int(s)) for r, o, c, s in zip(f.raw, f.payload_offset, f[clock], f[stamps], strict=True)]
            yield f

    return p.where(~moved).unionByName(p.where(moved).mapInPandas(run, p.select(rest).schema))


def merge_clips(p: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The union of packet ranges [start, end) played without holes: later segments move in time by what was left out, and each PID's
    counters by one offset per segment, so that seams join and damage inside stays."""
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    segs = p.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "seg int, a long, b long")
    rows = p.join(F.broadcast(segs), (F.col("packet_index") >= F.col("a")) & (F.col("packet_index") < F.col("b"))).drop("a", "b")
    clocks = rows.where("pcr_base is not null and not tei").groupBy("seg").agg(F.min_by("pcr_base", "packet_index").alias("first"), F.max_by("pcr_base", "packet_index").alias("last"), F.count(F.lit(1)).alias("n"))
    # as many rows as clips; the step over a seam is the mean step of the segment before
    shift, last, step, moves = 0, None, 0, []
    for r in clocks.orderBy("seg").collect():
        if last is not None:
            shift = last + step - r["first"]
        last = r["last"] + shift
        step = (r["last"] - r["first"]) // (r["n"] - 1) if r["n"] > 1 else step
        moves.append((r["seg"], shift))
    shifts = p.sparkSession.createDataFrame(moves, "seg int, move long")
    rows = rows.join(F.broadcast(shifts), "seg", "left").na.fill(0, ["move"])
    rows = shift_timestamps(rows, "move", "move")
    return joined_counters(rows.withColumn("sub_index", F.lit(0)).select("path", "pid", "seg", "packet_index", "sub_index", "has_payload", "tei", "cc", "header", "raw"))


def joined_counters(rows: DataFrame) -> DataFrame:
    """(packet_index, sub_index, raw) of packets in segments (``seg``, in order): each PID's counters move by one offset per segment, so that seams join what was
    written before them and gaps inside a segment stay."""
    counted, at = F.col("has_payload") & ~F.col("tei"), F.struct("packet_index", "sub_index")
    ends = rows.where(counted).groupBy("path", "pid", "seg").agg(F.min_by("cc", at).alias("first"), F.max_by("cc", at).alias("last"))
    w = Window.partitionBy("path", "pid").orderBy("seg")
    ends = ends.withColumn("__seam", F.coalesce(F.lag("last").over(w) + 1 - F.col("first"), F.lit(0)))
    ends = ends.withColumn("__off", F.sum("__seam").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("path", "pid", "seg", "__off")
    rows = rows.join(F.broadcast(ends), ["path", "pid", "seg"], "left")  # a row for each PID and segment
    cc = F.pmod(F.col("cc") + F.coalesce("__off", F.lit(0)), F.lit(16))
    return rows.select("packet_index", "sub_index", with_header(F.col("raw"), renumbered(F.col("header"), cc=cc)).alias("raw"))


def extract_elementary(p: DataFrame, faults: DataFrame, pids: list[int]) -> DataFrame:
    """(path, pid, packet_index, payload) of elementary streams: packet and PES headers off, duplicates out. Damage stops a stream until its next start."""
    fault = faults.where(F.col("pid").isin(pids)).select("path", "pid", "packet_index", "fault")
    rows = p.where(F.col("pid").isin(pids)).join(fault, ["path", "pid", "packet_index"], "left")
    f = F.coalesce("fault", F.lit(""))
    broken = F.col("tei") | F.col("parse_error").isNotNull() | F.col("discontinuity") | f.isin("Gap", "ConflictingDuplicate") | (F.col("has_payload") & (F.col("scrambling") >= 2))
    taken = F.col("has_payload") & ~F.col("tei") & F.col("parse_error").isNull() & ~f.isin("Duplicate", "ConflictingDuplicate") & (F.col("scrambling") < 2)
    at = F.col("payload_offset")
    code = packet.number(F.col("raw"), at, 3) == 1
    start = taken & F.col("pusi")
    body = F.when(taken, F.substring("raw", at + 1, F.lit(184)))
    rows = rows.withColumns({"__start": start, "__body": body, "__mark": F.when(start, F.when(F.octet_length(body) < 3, 1).otherwise(F.coalesce(code, F.lit(False)).cast("int"))).when(broken, 0)})
    keys = ["path", "pid"]
    rows = seq.scan(rows, keys, "packet_index", sums={"__unit": F.col("__start").cast("long")}, lasts={"__good": F.col("__mark")})
    unit = [*keys, "__unit"]
    size = F.coalesce(F.octet_length("__body"), F.lit(0)).cast("long")
    rows = seq.scan(rows, unit, "packet_index", sums={"__upto": size}).withColumn("__from", F.col("__upto") - size)
    # a header may lie in several packets: whichever holds its fourth and its ninth byte tells how long it is
    own = lambda i: F.when((F.col("__from") <= i) & (F.col("__upto") > i), packet.number(F.col("__body"), (F.lit(i) - F.col("__from")).cast("int"), 1))
    rows = seq.scan(rows, unit, "packet_index", lasts={"__id": own(3), "__data": own(8)})
    header = F.when(F.col("__id").isin(list(packet.PLAIN_STREAM_IDS)), 6).otherwise(9 + F.col("__data"))
    skip = F.greatest(F.lit(0), F.coalesce(header - F.col("__from"), F.lit(184))).cast("int")
    es = rows.where("__good = 1 and __body is not null and __unit > 0").withColumn("payload", F.substring("__body", skip + 1, F.lit(184)))
    return es.where(F.octet_length("payload") > 0).select("path", "pid", "packet_index", "payload")


def extraction_totals(p: DataFrame, faults: DataFrame, pids: list[int]) -> DataFrame:
    """Anomalies per track: transport errors, counter errors, bad headers, scrambled packets; duplicates are not among them."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    rows = p.where(F.col("pid").isin(pids)).join(faults.select("path", "pid", "packet_index", "fault"), ["path", "pid", "packet_index"], "left")
    out = rows.groupBy("path", "pid").agg(
        n(F.col("tei")).alias("transport_errors"), n(F.col("fault").isin("Gap", "ConflictingDuplicate")).alias("continuity_errors"), n(F.col("parse_error").isNotNull() & ~F.col("tei")).alias("invalid"),
        n(F.col("has_payload") & ~F.col("tei") & (F.col("scrambling") >= 2)).alias("scrambled"), n(F.col("fault").isin("Duplicate", "ConflictingDuplicate")).alias("duplicates"))
    return out.withColumn("anomalies", F.col("transport_errors") + F.col("continuity_errors") + F.col("invalid") + F.col("scrambled"))


def overlap(a: DataFrame, b: DataFrame, least: int = 32) -> int:
    """Packets in the longest suffix of ``a`` that is a prefix of ``b`` (0: none of ``least`` or more), by hashes of whole packets.

    Candidates are the places in ``a`` of the packet of ``b``'s first 256 that is rarest there; each is then counted in full."""
    n = a.agg(F.max("packet_index")).first()[0]
    if n is None or b.isEmpty():
        return 0
    n += 1
    own = a.select(F.col("packet_index").alias("i"), F.xxhash64("raw").alias("h"))
    other = b.select(F.col("packet_index").alias("j"), F.xxhash64("raw").alias("h"))
    head = other.where("j < 256")
    probe = own.join(F.broadcast(head), "h").groupBy("j").agg(F.count(F.lit(1)).alias("places")).orderBy("places", "j").first()
    # every overlap long enough holds the first packets of b, so it holds a probe among the first ``least``
    early = own.join(F.broadcast(head.where(F.col("j") < least)), "h").groupBy("j").agg(F.count(F.lit(1)).alias("places"))
    if probe is None or early.isEmpty():
        return 0
    best = early.orderBy("places", "j").first()
    shifts = own.join(F.broadcast(head.where(F.col("j") == best["j"])), "h").select((F.col("i") - F.col("j")).alias("shift")).where(f"shift >= 0 and {n} - shift >= {least}").distinct()
    hits = shifts.join(own, F.col("i") >= F.col("shift")).withColumn("j", F.col("i") - F.col("shift")).join(other, ["j", "h"]).groupBy("shift").agg(F.count(F.lit(1)).alias("same"))
    found = hits.where(f"same = {n} - shift").agg(F.max("same").alias("same")).first()
    return found["same"] or 0


def merge_files(parts: list[DataFrame], allow_gaps: bool = False) -> DataFrame:
    """Files one after the other, each without what the one before ends with; a file that adds nothing is left out."""
    out, base, at = None, None, 0
    for i, part in enumerate(parts):
        skip = overlap(base, part) if base is not None else 0
        total = part.agg(F.max("packet_index")).first()[0]
        total = 0 if total is None else total + 1
        if base is not None and not skip and not allow_gaps:
            raise ValueError(f"file {i} does not continue the one before")
        if skip == total:
            continue
        rows = part.where(F.col("packet_index") >= skip).select((F.col("packet_index") - skip + at).alias("packet_index"), F.lit(0).alias("sub_index"), "raw")
        at += total - skip
        base = part
        out = rows if out is None else out.unionByName(rows)
    return out
