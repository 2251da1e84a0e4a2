"""Aggregates over packets and events: PID summaries, coalesced events, verdicts, bitrates, the bitrate timeline and a text report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import streams, text
from packetloom.operators import seq
from packetloom.operators.catalog import Catalog

GAP_PACKETS = 256
STORED_EVENTS = 20_000


def coalesce(events: DataFrame, gap: int = GAP_PACKETS) -> DataFrame:
    """Events of one (severity, type, PID) that follow within ``gap`` packets become one, with the first one's arguments."""
    e = events.where("packet_index is not null").groupBy("path", "severity", "type", "pid", "packet_index").agg(
        F.count(F.lit(1)).alias("__n"), F.min("file_offset").alias("file_offset"), F.first("code").alias("code"), *[F.min(f"arg{i}").alias(f"arg{i}") for i in (1, 2, 3)])
    keys = ["path", "severity", "type", "pid"]
    e = seq.scan(e, keys, "packet_index", lags={"__was": F.col("packet_index")})
    e = seq.scan(e, keys, "packet_index", sums={"__session": (F.col("__was").isNull() | (F.col("packet_index") - F.col("__was") > gap)).cast("long")})
    first = [F.min_by(c, "packet_index").alias(c) for c in ("file_offset", "code", "arg1", "arg2", "arg3")]
    merged = e.groupBy(*keys, "__session").agg(F.min("packet_index").alias("start_packet"), F.max("packet_index").alias("end_packet"), F.sum("__n").alias("occurrences"), *first).drop("__session")
    rest = events.where("packet_index is null").select(*keys, F.lit(None).cast("long").alias("start_packet"), F.lit(None).cast("long").alias("end_packet"), F.lit(1).cast("long").alias("occurrences"), "file_offset", "code", "arg1", "arg2", "arg3")
    return merged.unionByName(rest)


def capped(merged: DataFrame, limit: int = STORED_EVENTS) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` events, and how many occurrences are left out."""
    kept = merged.orderBy("start_packet", "path", "type", "pid").limit(limit)
    total = merged.agg(F.sum("occurrences").alias("all"))
    return kept, total.crossJoin(kept.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("kept"))).select((F.col("all") - F.col("kept")).alias("omitted"))


def totals(events: DataFrame) -> DataFrame:
    """Errors and warnings per PID (null: of no PID) and over all, by grouping sets; ``level`` 1 is the whole."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return events.groupingSets([["path", "pid"], ["path"]], "path", "pid").agg(F.grouping("pid").alias("level"), n("Error").alias("errors"), n("Warning").alias("warnings"))


def verdict(events: DataFrame, complete: bool = True) -> str:
    if not complete:
        return "Incomplete"
    found = {r["severity"] for r in events.select("severity").distinct().collect()}
    return "Error" if "Error" in found else "Warning" if "Warning" in found else "Pass"


def pid_summary(packets: DataFrame, events: DataFrame, c: Catalog) -> DataFrame:
    """Counts per PID with its role; payload counts leave transport errors out."""
    sound = F.col("has_payload") & ~F.col("tei")
    n = lambda cond: F.sum(cond.cast("long"))
    base = packets.groupBy("path", "pid").agg(F.count(F.lit(1)).alias("packet_count"), n(sound).alias("payload_packets"), n(sound & (F.col("scrambling") >= 2)).alias("scrambled_payload_packets"))
    kinds = {"continuity_errors": "type in ('ContinuityGap', 'ConflictingDuplicate')", "transport_errors": "type = 'TransportError'", "pes_size_errors": "type = 'PesSizeMismatch'", "duplicate_packets": "type = 'DuplicatePacket'", "error_count": "severity = 'Error'", "warning_count": "severity = 'Warning'"}
    marks = events.where("pid is not null").groupBy("path", "pid").agg(*[n(F.expr(cond)).alias(name) for name, cond in kinds.items()])
    types = c.streams.groupBy("path", "pid").agg(F.max_by("stream_type", "packet_index").alias("stream_type"), F.max_by("stream_name", "packet_index").alias("stream_name"), F.max_by("language", "packet_index").alias("language"))
    pcr = c.programs.select("path", F.col("pcr_pid").alias("pid")).distinct().withColumn("is_pcr_pid", F.lit(True))
    pmt = c.pat.select("path", F.col("pmt_pid").alias("pid")).distinct().withColumn("is_pmt_pid", F.lit(True))
    out = base.join(marks, ["path", "pid"], "left")
    for dim in (types, pcr, pmt):  # at most 8192 rows a file
        out = out.join(F.broadcast(dim), ["path", "pid"], "left")
    total = F.sum("packet_count").over(Window.partitionBy("path"))
    out = out.na.fill(0, list(kinds)).na.fill(False, ["is_pcr_pid", "is_pmt_pid"])
    return out.withColumn("share", F.col("packet_count") * 100.0 / total)


def bitrate(packets: DataFrame, pcr: DataFrame, c: Catalog) -> DataFrame:
    """Rate of each file from the longest clean stretch of its first program's clock, dealt to PIDs by their packets."""
    ref = c.programs.groupBy("path").agg(F.min_by("pcr_pid", F.struct("packet_index", "program_number")).alias("pid"))
    rows = pcr.join(F.broadcast(ref), ["path", "pid"])
    rows = seq.scan(rows, ["path"], "packet_index", sums={"__run": (F.col("delta").isNull() | (F.col("delta") <= 0) | (F.col("delta") > 90_000)).cast("long")})
    runs = rows.groupBy("path", "__run").agg((F.max("t") - F.min("t")).alias("ticks"), (F.max("packet_index") - F.min("packet_index")).alias("n"), F.min("packet_index").alias("start")).where("ticks >= 45000")
    best = seq.best(runs, ["path"], [-F.col("ticks"), F.col("start")], ["ticks", "n"])
    rate = best.select("path", (F.col("n") * 188 * 8 * 90000.0 / F.col("ticks")).alias("total_bitrate"))
    counts = packets.groupBy("path", "pid").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("path"))
    return counts.join(F.broadcast(rate), "path").select("path", "pid", "total_bitrate", (F.col("total_bitrate") * share).alias("bitrate"))


def clock_spans(pcr: DataFrame, c: Catalog) -> DataFrame:
    """(path, a, b, at, seconds, segment): the intervals between the clocks of each file's first program, laid end to end from 0 on.

    Abnormal intervals (backwards or over ten seconds) take the running estimate of seconds per packet and open a new segment. The clock samples of one PID
    per file are folded in one task; packets are not."""
    ref = c.programs.groupBy("path").agg(F.min_by("pcr_pid", F.struct("packet_index", "program_number")).alias("pid"))
    samples = pcr.join(F.broadcast(ref), ["path", "pid"]).select("path", "packet_index", "t", "clock_segment")

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("packet_index")
        out, at, segment, rate, last = [], 0.0, 0, None, None
        for r in f.itertuples():
            if last is not None:
                n, d = r.packet_index - last.packet_index, r.t - last.t
                odd = r.clock_segment != last.clock_segment or d <= 0 or d > 900_000
                seconds = (rate or 0.0) * n if odd else d / 90_000
                segment += odd
                rate = rate if odd else seconds / n if rate is None else rate * 7 / 8 + seconds / n / 8
                out.append((r.path, last.packet_index, r.packet_index, at, seconds, segment))
                at += seconds
            last = r
        return pd.DataFrame(out, columns=["path", "a", "b", "at", "seconds", "segment"])

    return samples.groupBy("path").applyInPandas(fold, "path string, a long, b long, at double, seconds double, segment int")


def display_times(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (path, packet_index) with ``display_s``, their place on the timeline: the interval's start plus the packets since, at its rate; after the last clock at
    the last interval's rate, before the first none."""
    rate = F.col("seconds") / (F.col("b") - F.col("a"))
    marks = spans.select("path", F.col("a").alias("packet_index"), F.struct("at", rate.alias("rate"), F.col("a").alias("a")).alias("s"))
    return seq.asof(rows, marks, ["path"], "packet_index", "s", "__s").withColumn("display_s", F.col("__s.at") + (F.col("packet_index") - F.col("__s.a")) * F.col("__s.rate")).drop("__s")


def bitrate_at(times: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (path, time_s) with the bucket that holds them and its rate; buckets of a file are equally wide, so an equi-join finds them."""
    width = buckets.groupBy("path").agg(F.max("duration_s").alias("__w"))
    rows = times.join(F.broadcast(width), "path", "left").withColumn("__b", F.floor(F.col("time_s") / F.col("__w")))
    b = buckets.select("path", F.floor(F.col("start_s") / F.col("duration_s")).alias("__b"), "start_s", "duration_s", (F.col("total_packets") * 1504 / F.col("duration_s")).alias("bucket_bitrate"))
    return rows.join(b, ["path", "__b"], "left").drop("__b", "__w")


def timeline(packets: DataFrame, pcr: DataFrame, c: Catalog, width_s: float = 1.0, most: int = 4096) -> DataFrame:
    """Packets per bucket and PID: those of each clock interval spread over the buckets that it overlaps, in proportion.

    More than ``most`` buckets merge pairwise, so widths double."""
    spans = clock_spans(pcr, c).where("seconds > 0")
    marks = spans.select("path", F.col("a").alias("packet_index"), F.struct("a", "b", "at", "seconds", "segment").alias("span"))
    rows = seq.asof(packets.select("path", "pid", "packet_index"), marks, ["path"], "packet_index", "span", "s").where("s is not null and packet_index < s.b")
    per = rows.groupBy("path", "s", "pid").agg(F.count(F.lit(1)).alias("n"))
    end = spans.groupBy("path").agg(F.max(F.col("at") + F.col("seconds")).alias("__end"))
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.ceil(F.col("__end") / width_s) / float(most))))
    per = per.join(F.broadcast(end), "path").withColumn("width", width_s * F.pow(F.lit(2.0), power))
    lo, hi = F.col("s.at"), F.col("s.at") + F.col("s.seconds")
    per = per.withColumn("bucket", F.explode(F.sequence(F.floor(lo / F.col("width")), F.greatest(F.floor(lo / F.col("width")), F.ceil(hi / F.col("width") - 1e-9) - 1))))
    lap = F.least(hi, (F.col("bucket") + 1) * F.col("width")) - F.greatest(lo, F.col("bucket") * F.col("width"))
    part = per.groupBy("path", "bucket", "width", "pid").agg(F.sum(F.col("n") * lap / F.col("s.seconds")).alias("packet_count"), F.min("s.segment").alias("segment"))
    return part.groupBy("path", (F.col("bucket") * F.col("width")).alias("start_s"), F.col("width").alias("duration_s")).agg(
        F.sum("packet_count").alias("total_packets"), F.min("segment").alias("segment"), F.array_sort(F.collect_list(F.struct("pid", "packet_count"))).alias("pids"))


def event_times(events: DataFrame, pcr: DataFrame, pts: DataFrame, c: Catalog) -> DataFrame:
    """Seconds of packet events, relative to the first clock of the file: by the last value of the program's PCR at or before them, else of any PCR,
    else of the PID's own PTS. ``pcr`` and ``pts``: :func:`detect.clock_rows`. Events without any clock before them have none."""
    sample = lambda df: df.select("path", "pid", "packet_index", "t")
    both = sample(pcr).unionByName(sample(pts))
    origin = both.groupBy("path").agg(F.min_by("t", "packet_index").alias("origin"))
    number = c.programs.groupBy("path", "program_number").agg(F.max_by("pcr_pid", "packet_index").alias("clock_pid"))
    owner = c.streams.select("path", "program_number", "pid").unionByName(c.pat.select("path", "program_number", F.col("pmt_pid").alias("pid")))
    owner = owner.unionByName(number.select("path", "program_number", F.col("clock_pid").alias("pid"))).groupBy("path", "pid").agg(F.min("program_number").alias("program_number"))
    owner = owner.join(number, ["path", "program_number"]).select("path", "pid", "clock_pid")  # at most 8192 rows a file
    e = events.where("packet_index is not null").join(F.broadcast(owner), ["path", "pid"], "left")
    e = seq.asof(e, sample(pcr).withColumnRenamed("pid", "clock_pid"), ["path", "clock_pid"], "packet_index", "t", "__own")
    e = seq.asof(e, sample(pcr).groupBy("path", "packet_index").agg(F.max_by("t", "pid").alias("t")), ["path"], "packet_index", "t", "__any")
    e = seq.asof(e, sample(pts), ["path", "pid"], "packet_index", "t", "__pts")
    e = e.join(F.broadcast(origin), "path", "left").withColumn("__t", F.coalesce("__own", "__any", "__pts"))
    e = e.withColumns({"time_s": F.greatest(F.lit(0.0), (F.col("__t") - F.col("origin")) / 90_000.0), "source_time_s": F.col("__t") / 90_000.0})
    return e.withColumn("time_s", F.when(F.col("__t").isNotNull(), F.col("time_s"))).drop("__own", "__any", "__pts", "__t", "origin", "clock_pid")


def report(summary: DataFrame, merged: DataFrame, c: Catalog, buckets: DataFrame | None = None, events: int = STORED_EVENTS) -> str:
    """A text report of bounded size: programs, PIDs (at most 8192 a file) and the first events."""
    lines = ["Transport stream report", ""]
    if buckets is not None and (r := buckets.agg(F.sum("total_packets").alias("n"), F.sum("duration_s").alias("s"), F.max(F.col("total_packets") * 1504 / F.col("duration_s")).alias("peak")).first()) and r["s"]:
        lines.append(f"Bitrate: average {r['n'] * 1504 / r['s'] / 1e6:.3f} Mb/s, peak {r['peak'] / 1e6:.3f} Mb/s")
    for p in c.programs.orderBy("path", "program_number").collect():
        lines.append(f"Program {p.program_number}: PMT 0x{p.pmt_pid:04X}, PCR 0x{p.pcr_pid:04X}")
    for r in summary.orderBy("path", "pid").collect():
        kind = streams.name_of(r.stream_type) if r.stream_type is not None else "PMT" if r.is_pmt_pid else "-"
        lines.append(f"PID 0x{r.pid:04X} {kind}: {r.packet_count} packets ({r.share:.2f} %), {r.error_count} errors, {r.warning_count} warnings")
    for r in merged.orderBy("start_packet", "type", "pid").select("severity", "type", text.hex_pid(F.col("pid")).alias("pid"), "start_packet", "end_packet", "occurrences").limit(events).collect():
        lines.append(f"{r.severity} {r.type} PID {r.pid} packets {r.start_packet}-{r.end_packet} x{r.occurrences}")
    return "\n".join(lines) + "\n"


def context_range(events: DataFrame, packets_per_second: float, last_packet: int, seconds: float = 15.0) -> DataFrame:
    """The packets around each event, clamped to the stream."""
    reach = int(packets_per_second * seconds)
    return events.withColumns({"sample_start": F.greatest(F.lit(0), F.col("start_packet") - reach), "sample_end": F.least(F.lit(last_packet), F.col("end_packet") + reach)})
