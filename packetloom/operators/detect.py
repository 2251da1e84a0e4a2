"""Detectors over decoded packets, as windows; each gives events of one schema.

What resets what is explicit in segment columns: transport errors and discontinuities cut counters and PES units, only discontinuities cut
clocks, a counter gap cuts PES units. Packets with transport errors show in no other detector.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import packet, streams
from packetloom.operators import seq
from packetloom.operators.catalog import Catalog

TICKS = 90_000
WRAP = 1 << 33
KEYS = ["path", "pid"]
EVENT_COLUMNS = ["path", "severity", "type", "pid", "packet_index", "file_offset", "code", "arg1", "arg2", "arg3"]


def _events(df: DataFrame, severity: str | Column, kind: str | Column, code: str | Column | None = None, *args: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    extra = [*args, F.lit(None), F.lit(None), F.lit(None)][:3]
    return df.select(
        "path", lit(severity).alias("severity"), lit(kind).alias("type"), F.col("pid").cast("int"), F.col("packet_index").cast("long"), F.col("file_offset").cast("long"),
        lit(code if code is not None else kind).alias("code"), *[a.cast("double").alias(f"arg{i}") for i, a in enumerate(extra, 1)],
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def transport_errors(p: DataFrame) -> DataFrame:
    return _events(p.where("tei"), "Error", "TransportError")


def bad_headers(p: DataFrame) -> DataFrame:
    rows = p.where("not tei and parse_error in ('ReservedAdaptationControl', 'InvalidAdaptationLength')")
    length = F.col("parse_error") == "InvalidAdaptationLength"
    return _events(rows, "Error", F.when(length, "SyncLoss").otherwise("InvalidPacketHeader"), F.col("parse_error"))


def sync_losses(losses: DataFrame) -> DataFrame:
    rows = losses.select("path", F.lit(None).cast("int").alias("pid"), F.lit(None).cast("long").alias("packet_index"), F.col("start").alias("file_offset"), "end")
    return _events(rows, "Error", "SyncLoss", "SyncRecovered", F.col("end") - F.col("file_offset"))


def continuity_rows(p: DataFrame) -> DataFrame:
    """Payload packets with ``fault``: Duplicate, ConflictingDuplicate, Gap or null; ``missing`` for gaps."""
    p = p.where(F.col("pid") != packet.NULL_PID)
    p = seq.scan(p.withColumn("body", F.xxhash64(F.substring("raw", 5, 184))), KEYS, "packet_index", sums={"__cut": (F.col("tei") | F.col("discontinuity")).cast("long")})
    rows = p.where("has_payload and not tei and parse_error is null")
    cut = [*KEYS, "__cut"]
    rows = seq.scan(rows, cut, "packet_index", lags={"last_cc": F.col("cc")})
    # only the first packet of a run of equal counters is ever the baseline
    rows = seq.scan(rows, cut, "packet_index", lasts={"first_body": F.when(F.col("last_cc").isNull() | (F.col("last_cc") != F.col("cc")), F.col("body"))})
    off = F.pmod(F.col("cc") - F.col("last_cc") - 1, F.lit(16))
    fault = F.when(F.col("last_cc").isNull(), None).when(F.col("last_cc") == F.col("cc"), F.when(F.col("body") == F.col("first_body"), "Duplicate").otherwise("ConflictingDuplicate")).when(off != 0, "Gap")
    return rows.withColumns({"fault": fault, "missing": F.when(off != 0, off)})


def continuity(rows: DataFrame) -> DataFrame:
    fault = F.col("fault")
    kind = F.when(fault == "Duplicate", "DuplicatePacket").when(fault == "Gap", "ContinuityGap").otherwise(fault)
    gap = fault == "Gap"
    first = F.when(gap, F.pmod(F.col("last_cc") + 1, F.lit(16))).otherwise(F.col("cc"))
    return _events(rows.where("fault is not null"), F.when(fault == "Duplicate", "Warning").otherwise("Error"), kind, kind, first, F.when(gap, F.col("cc")), F.when(gap, F.col("missing")))


def repeats(rows: DataFrame) -> DataFrame:
    """Packets that carry the counter of the one before: what stands in them counts no second time."""
    return rows.where("fault in ('Duplicate', 'ConflictingDuplicate')").select("path", "pid", "packet_index")


def clock_rows(p: DataFrame, column: str, without: DataFrame | None = None) -> DataFrame:
    """Rows with a clock value: ``t`` unwrapped within its segment and ``delta`` to the value before. ``without``: packets whose values do not count."""
    p = seq.scan(p, KEYS, "packet_index", sums={"clock_segment": (F.col("discontinuity") & ~F.col("tei")).cast("long")})
    rows = p.where(F.col(column).isNotNull() & ~F.col("tei") & F.col("parse_error").isNull())
    rows = rows if without is None else rows.join(without, [*KEYS, "packet_index"], "left_anti")
    keys = [*KEYS, "clock_segment"]
    rows = seq.unwrap(rows, keys, "packet_index", column, out="t")
    return seq.scan(rows, keys, "packet_index", lags={"last_t": F.col("t"), "last_packet": F.col("packet_index")}).withColumn("delta", F.col("t") - F.col("last_t"))


def pcr_checks(rows: DataFrame) -> DataFrame:
    d = F.col("delta")
    kind = F.when(d < -90, "PcrBackward").when(d > 10 * TICKS, "PcrJump").when(d > TICKS // 2, "PcrGap")
    rows = rows.withColumn("__kind", kind).where("__kind is not null")
    return _events(rows, F.when(F.col("__kind") == "PcrGap", "Warning").otherwise("Error"), F.col("__kind"), F.col("__kind"), F.when(d < 0, -d).otherwise(d) / TICKS)


def declared(rows: DataFrame, c: Catalog) -> DataFrame:
    """Rows of streams that a PMT had declared by then, with their type."""
    s = c.streams.groupBy("path", "pid").agg(F.min("packet_index").alias("__from"), F.max_by("stream_type", "packet_index").alias("stream_type"), F.max_by("supplement", "packet_index").alias("supplement"))
    return rows.join(F.broadcast(s), KEYS).where("packet_index > __from").drop("__from")


def is_video() -> Column:
    return F.col("stream_type").isin(list(streams.VIDEO))


def is_audio(supplements: bool = True) -> Column:
    own = F.col("stream_type").isin(list(streams.AUDIO))
    return own | F.coalesce(F.col("supplement").isin(list(streams.AUDIO_SUPPLEMENTS)), F.lit(False)) if supplements else own


def pts_checks(rows: DataFrame, c: Catalog) -> DataFrame:
    d = F.col("delta")
    kind = F.when(~is_video() & (d < -90), "PtsBackward").when(d > 10 * TICKS, "PtsJump").when(~is_video() & (d > 2 * TICKS), "StreamGap")
    rows = declared(rows, c).withColumn("__kind", kind).where("__kind is not null")
    gap = F.col("__kind") == "StreamGap"
    return _events(rows, F.when(gap, "Warning").otherwise("Error"), F.col("__kind"), F.when(gap, "AudioGap").otherwise(F.col("__kind")), F.abs(d) / TICKS)


def dts_checks(rows: DataFrame, c: Catalog) -> DataFrame:
    rows = declared(rows, c)
    back = _events(rows.where("delta < -90"), "Error", "DtsBackward", "DtsBackward", -F.col("delta") / TICKS)
    lead = F.pmod(F.col("dts") - F.col("pts"), F.lit(WRAP))
    after = rows.where((lead > 90) & (lead < WRAP // 2))
    return back.unionByName(_events(after, "Error", "DtsAfterPts", "DtsAfterPts", lead / TICKS))


def _units(p: DataFrame, rows: DataFrame, c: Catalog) -> DataFrame:
    """Packets of declared streams with their PES ``unit``: ``__start``, what counts (``__taken``), what voids (``__broken``)."""
    fault = rows.select("path", "pid", "packet_index", "fault")
    all_ = declared(p, c).join(fault, ["path", "pid", "packet_index"], "left")
    sound = F.col("has_payload") & ~F.col("tei") & F.col("parse_error").isNull()
    taken = sound & ~F.coalesce(F.col("fault").isin("Duplicate", "ConflictingDuplicate"), F.lit(False))
    broken = F.col("tei") | F.col("parse_error").isNotNull() | F.col("discontinuity") | F.coalesce(F.col("fault").isin("ConflictingDuplicate", "Gap"), F.lit(False))
    all_ = all_.withColumns({"__taken": taken, "__start": taken & F.col("pusi"), "__broken": broken})
    return seq.scan(all_, KEYS, "packet_index", sums={"unit": F.col("__start").cast("long")})


def _placed(units: DataFrame, head: int) -> DataFrame:
    """Adds where a packet's payload stands in its unit (``__from``, ``__upto``) and, as hex, its part of the unit's first ``head`` bytes."""
    size = F.when(F.col("__taken"), packet.SIZE - F.col("payload_offset")).otherwise(0).cast("long")
    rows = seq.scan(units, [*KEYS, "unit"], "packet_index", sums={"__upto": size}).withColumn("__from", F.col("__upto") - size)
    part = F.substring("raw", F.col("payload_offset") + 1, F.greatest(F.lit(0), F.lit(head) - F.col("__from")).cast("int"))
    return rows.withColumn("__part", F.when(F.col("__taken") & (F.col("__from") < head), F.hex(part)))


def _joined(column: str = "__part") -> Column:
    """Parts in order of their packets; at most as many as a unit's first bytes have."""
    parts = F.collect_list(F.when(F.col(column).isNotNull(), F.struct("packet_index", column)))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x[column]), "")


def pes_sizes(p: DataFrame, rows: DataFrame, c: Catalog) -> DataFrame:
    """Units whose bytes differ from the declared length: (bytes after the length field, declared ones, difference).

    A unit is settled by the next start; damage inside voids it. The six bytes that declare the length may lie in several packets."""
    all_ = _placed(_units(p, rows, c), 6)
    units = all_.groupBy("path", "pid", "unit").agg(
        F.max("__upto").alias("got"), _joined().alias("head"), F.max(F.struct("__start", "packet_index", "file_offset")).alias("s"),
        F.max((F.col("__broken") & ~F.col("__start")).cast("int")).alias("killed"))
    seam = all_.where("__broken and __start").select("path", "pid", (F.col("unit") - 1).alias("unit")).distinct().withColumn("__seam", F.lit(1))
    last = units.groupBy("path", "pid").agg(F.max("unit").alias("__last"))
    whole = units.join(F.broadcast(last), KEYS).join(seam, ["path", "pid", "unit"], "left").where("unit > 0 and unit < __last and killed = 0 and __seam is null and head like '000001______'")
    bad = whole.select("path", "pid", "s.packet_index", "s.file_offset", F.conv(F.substring("head", 9, 4), 16, 10).cast("long").alias("want"), F.greatest(F.lit(0), F.col("got") - 6).alias("got"))
    return _events(bad.where("want > 0 and got <> want"), "Error", "PesSizeMismatch", "PesSizeMismatch", F.col("got"), F.col("want"), F.col("got") - F.col("want"))


def remaining_bytes(p: DataFrame, rows: DataFrame, c: Catalog) -> DataFrame:
    """(path, pid, packet_index, remaining): what the unit's declared length leaves after each packet; null where none is declared or damage came before."""
    all_ = _placed(_units(p, rows, c), 6)
    head = all_.groupBy("path", "pid", "unit").agg(_joined().alias("head")).where("head like '000001______' and unit > 0")
    head = head.select("path", "pid", "unit", F.conv(F.substring("head", 9, 4), 16, 10).cast("long").alias("want"))
    all_ = seq.scan(all_, [*KEYS, "unit"], "packet_index", sums={"__hurt": (F.col("__broken") & ~F.col("__start")).cast("long")})
    left = F.when((F.col("want") > 0) & (F.col("__hurt") == 0), F.col("want") + 6 - F.col("__upto"))
    return all_.where("__taken").join(head, ["path", "pid", "unit"], "left").select("path", "pid", "packet_index", left.alias("remaining"))


#: The longest PES header that is put together from several packets.
HEADER = 64


def late_stamps(p: DataFrame, rows: DataFrame, c: Catalog) -> DataFrame:
    """(path, pid, packet_index, pts, dts) of PES headers that lie in several packets, at the packet that completes them; damage on the way voids one."""
    room = packet.SIZE - F.col("payload_offset")
    longer = F.col("__start") & ((room < 9) | (9 + packet.number(F.col("raw"), F.col("payload_offset") + 8, 1) > room))
    units = seq.scan(_units(p, rows, c), KEYS, "packet_index", lasts={"__long": F.when(F.col("__start"), longer)}).where("__long and unit > 0")
    all_ = _placed(units, HEADER).withColumn("__end", F.when(F.col("__part").isNotNull(), F.struct("packet_index", "__upto")))
    heads = all_.where("__from < 64").groupBy("path", "pid", "unit").agg(
        _joined().alias("head"), F.array_sort(F.collect_list("__end")).alias("ends"), F.min(F.when(F.col("__broken") & ~F.col("__start"), F.col("packet_index"))).alias("hurt"))
    byte = lambda i: F.conv(F.substring("head", 2 * i + 1, 2), 16, 10).cast("int")
    heads = heads.where("length(head) >= 18").withColumn("total", 9 + byte(8)).where(f"head like '000001%' and total <= {HEADER} and length(head) >= 2 * total")
    heads = heads.withColumn("packet_index", F.filter("ends", lambda e: e["__upto"] >= F.col("total"))[0]["packet_index"]).where("hurt is null or hurt > packet_index")
    number = lambda at: F.conv(F.substring("head", 2 * at + 1, 10), 16, 10).cast("long")
    flags = F.shiftright(byte(7), 6)
    return heads.select(
        "path", "pid", "packet_index", F.when((flags >= 2) & (F.col("total") >= 14), packet.timestamp33(number(9))).alias("pts"),
        F.when((flags == 3) & (F.col("total") >= 19), packet.timestamp33(number(14))).alias("dts")).where("pts is not null")


def with_late_stamps(p: DataFrame, rows: DataFrame, c: Catalog) -> DataFrame:
    """Packets whose timestamps include those of headers that lie in several packets."""
    late = late_stamps(p, rows, c).select("path", "pid", "packet_index", F.col("pts").alias("__pts"), F.col("dts").alias("__dts"))
    out = p.join(late, [*KEYS, "packet_index"], "left")
    return out.withColumns({"pts": F.coalesce("pts", "__pts"), "dts": F.coalesce("dts", "__dts")}).select(*p.columns)


def repair_candidates(pcr: DataFrame) -> DataFrame:
    """(path, pid) whose clock hints at a repairable timeline: a fold over clock samples, as outliers must not enter the rate."""
    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("packet_index")
        rates: list[float] = []
        odd, hit = 0, False
        for n, d in zip((f.packet_index - f.last_packet).tolist(), f.delta.tolist(), strict=True):
            if not n > 0:
                continue
            known = len(rates) >= 5
            error = abs(d - n * sorted(rates)[len(rates) // 2]) if known else 0
            hit |= known and error >= 90_000
            if 0 < d < 45_000:
                if known and error >= 22_500:
                    odd += 1
                    hit |= odd >= 3
                else:
                    odd = 0 if known else odd
                    rates = [*rates[-30:], d / n]
        return pd.DataFrame({"path": f.path[:1], "pid": f.pid[:1], "candidate": [hit]})

    rows = pcr.where("delta is not null").select("path", "pid", "packet_index", "last_packet", "delta")
    return rows.groupBy("path", "pid").applyInPandas(fold, "path string, pid int, candidate boolean").where("candidate").select("path", "pid")


def av_drift(p: DataFrame, c: Catalog, without: DataFrame | None = None) -> DataFrame:
    """Audio that drifts from video: a fold over one sample a second, each with the last timestamps of the program's streams."""
    own = c.streams.select("path", "program_number", "pid", "stream_type", "supplement").distinct()
    clocks = clock_rows(p, "pts", without).join(F.broadcast(own), KEYS).where(is_video() | is_audio())
    marks = clocks.select("path", "program_number", "packet_index", "file_offset", F.when(is_video(), -1).otherwise(F.col("pid")).alias("track"), "t")
    pcr = clock_rows(p, "pcr_base").join(F.broadcast(c.programs.select("path", "program_number", F.col("pcr_pid").alias("pid")).distinct()), KEYS)
    rows = marks.unionByName(pcr.select("path", "program_number", "packet_index", "file_offset", F.lit(-2).alias("track"), "t"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        # within a packet the clock comes before the timestamps
        f = f.sort_values(["packet_index", "track"])
        video, last, report = None, None, None
        audio: dict[int, float] = {}
        base: dict[int, list[float]] = {}
        count: dict[int, int] = {}
        out = []
        for r in f.itertuples():
            if r.track == -1:
                video = r.t
            elif r.track >= 0:
                audio[r.track] = r.t
            elif video is not None and (last is None or r.t - last >= TICKS):
                last = r.t
                for pid, t in audio.items():
                    b = base.setdefault(pid, [])
                    if len(b) < 5:
                        b.append(t - video)
                        b.sort() if len(b) == 5 else None
                    if len(b) < 5:
                        continue
                    drift = (t - video - b[2]) / TICKS
                    count[pid] = count.get(pid, 0) + 1 if abs(drift) >= 0.5 else 0
                    if count[pid] >= 3 and (report is None or r.t - report >= 5 * TICKS):
                        out.append((r.path, pid, r.packet_index, r.file_offset, b[2] / 90.0, (t - video) / 90.0, drift * 1000))
                        report = r.t
        return pd.DataFrame(out, columns=["path", "pid", "packet_index", "file_offset", "a", "b", "c"])

    found = rows.groupBy("path", "program_number").applyInPandas(fold, "path string, pid int, packet_index long, file_offset long, a double, b double, c double")
    return _events(found, "Warning", "AvSyncDrift", "AvSyncDrift", F.col("a"), F.col("b"), F.col("c"))


def structure(p: DataFrame, c: Catalog) -> DataFrame:
    """What a complete scan should have shown: PAT, else per program PMT, clock, and timestamps of its audio and video."""
    here = lambda df: df.withColumn("packet_index", F.lit(None).cast("long")).withColumn("file_offset", F.lit(None).cast("long"))
    paths = p.select("path").distinct()
    pat = here(paths.join(c.pat.select("path").distinct(), "path", "left_anti").withColumn("pid", F.lit(0)))
    pmt = here(c.pat.join(c.programs.select("path", "program_number").distinct(), ["path", "program_number"], "left_anti").select("path", F.col("pmt_pid").alias("pid")))
    seen = p.where("not tei and parse_error is null").groupBy("path", "pid").agg(F.max(F.col("pcr_base").isNotNull()).alias("pcr"), F.max(F.col("pts").isNotNull()).alias("stamps"), F.max("has_payload").alias("payload"))
    pcr = here(c.programs.select("path", F.col("pcr_pid").alias("pid")).distinct().where("pid <> 8191").join(seen.where("pcr"), KEYS, "left_anti"))
    media = c.streams.where(is_video() | is_audio(supplements=False)).select("path", "pid").distinct()
    stamp = here(media.join(seen.where("payload and not stamps"), KEYS).select("path", "pid"))
    return union([_events(df, "Error" if n in ("MissingPat", "MissingPmt") else "Warning", n) for df, n in ((pat, "MissingPat"), (pmt, "MissingPmt"), (pcr, "MissingPcr"), (stamp, "MissingTimestamp"))])


def psi_errors(c: Catalog) -> DataFrame:
    return _events(c.sections.where("not crc_ok"), "Error", "PsiCrcError", "PsiCrcError", F.col("table_id"))


FEATURES = ("continuity", "clocks", "timestamps", "pes", "av_sync", "structure", "psi")


def detect(p: DataFrame, c: Catalog, features: tuple[str, ...] = FEATURES, losses: DataFrame | None = None) -> DataFrame:
    """Events of the chosen detectors; plans of others are never built."""
    out = [transport_errors(p), bad_headers(p)]
    rows = continuity_rows(p) if {"continuity", "pes", "timestamps", "av_sync"} & set(features) else None
    again = repeats(rows) if "continuity" in features else None  # only a check of counters sees repeats
    stamped = with_late_stamps(p, rows, c) if {"timestamps", "av_sync"} & set(features) else p
    if losses is not None:
        out.append(sync_losses(losses))
    if "continuity" in features:
        out.append(continuity(rows))
    if "clocks" in features:
        out.append(pcr_checks(clock_rows(p, "pcr_base")))
    if "timestamps" in features:
        out += [pts_checks(clock_rows(stamped, "pts", again), c), dts_checks(clock_rows(stamped, "dts", again), c)]
    if "pes" in features:
        out.append(pes_sizes(p, rows, c))
    if "av_sync" in features:
        out.append(av_drift(stamped, c, again))
    if "structure" in features:
        out.append(structure(p, c))
    if "psi" in features:
        out.append(psi_errors(c))
    return union(out)
