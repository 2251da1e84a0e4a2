"""Queries that run the engine's operators over a whole stream made of the events table, each with SQL beside it.

The stream: a PAT, a PMT (program 1, clock on PID 256, H.264 on it and AAC on 257 to 263), then a packet for each event. Purchases and all packets of PID
256 carry a clock, signups start a PES unit with a timestamp, errors are transport errors; counters skip one at every 97th event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import packet, psi
from packetloom.operators import catalog, detect, edit, navigate, repair, seq, summary
from packetloom.plans import relational
from packetloom.plans.oracles import EV
from packetloom.session import shared_folder
from packetloom.sources import mpegts

QUERIES: dict[str, relational.Query] = {}
PATH = "tv"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def stream(spark, d) -> DataFrame:
    """path, packet_index (event_id + 2 for events), file_offset and raw."""
    e = relational.packets(spark, d).select("event_id", "header")
    pid, old = F.shiftright("header", 8).bitwiseAND(F.lit(0x1FFF)), F.shiftright("header", 4).bitwiseAND(F.lit(3))
    clocked, starts = (pid == 256) | (old == 3), F.shiftright("header", 22).bitwiseAND(F.lit(1)) == 1
    header = F.col("header").bitwiseAND(F.lit(~0x30)).bitwiseOR(F.when(clocked, 0x30).otherwise(0x10).cast("long"))
    bytes_of = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    ticks = F.pmod(F.col("event_id") * 3000, F.lit(1 << 33))
    clock = F.concat(F.lit(bytearray(b"\x07\x10")), bytes_of(F.shiftleft(ticks, 15).bitwiseOR(F.lit(0x7E00)), 6))
    part = lambda shift, mask, to: F.shiftleft(F.shiftright(ticks, shift).bitwiseAND(F.lit(mask)), to)
    stamp = part(30, 7, 33).bitwiseOR(part(15, 0x7FFF, 17)).bitwiseOR(part(0, 0x7FFF, 1)).bitwiseOR(F.lit(0x2100010001))
    unit = F.concat(F.lit(bytearray(b"\0\0\1\xe0\0\0\x80\x80\x05")), bytes_of(stamp, 5))
    head = F.concat(bytes_of(header, 4), F.when(clocked, clock).otherwise(F.lit(bytearray())), F.when(starts, unit).otherwise(F.lit(bytearray())))
    raw = F.substring(F.concat(head, F.lit(bytearray(b"\x55" * 184))), 1, 188)
    tables = psi.packetize(psi.build_pat(7, 3, {1: 0x1000}), 0, 0) + psi.packetize(psi.build_pmt(1, 0, 256, [(0x1B, 256, b""), *((0x0F, p, b"") for p in range(257, 264))]), 0x1000, 0)
    first = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(tables)], "packet_index long, raw binary")
    rows = first.unionByName(e.select((F.col("event_id") + 2).alias("packet_index"), raw.alias("raw")))
    return rows.select(F.lit(PATH).alias("path"), "packet_index", (F.col("packet_index") * 188).alias("file_offset"), "raw")


def _read(spark, d) -> tuple[DataFrame, catalog.Catalog]:
    p = packet.decode(stream(spark, d))
    return p, catalog.build(p)


def _found(p: DataFrame, c: catalog.Catalog, *features: str) -> DataFrame:
    return detect.detect(p, c, features or ("continuity", "clocks"))


@query
def eng_catalog(spark, d):
    _, c = _read(spark, d)
    return c.streams.join(c.programs.select("program_number", "pmt_pid", "pcr_pid"), "program_number").join(c.identity.select("tsid", "pat_version"), F.lit(True)).select("program_number", "pmt_pid", "pcr_pid", "tsid", "pat_version", "pid", "stream_type", "stream_name")


@query
def eng_events(spark, d):
    return _found(*_read(spark, d)).select("severity", "type", "pid", "packet_index", "file_offset", "code", *[F.round(f"arg{i}", 6).alias(f"arg{i}") for i in (1, 2, 3)])


@query
def eng_timestamp_events(spark, d):
    """PTS checks of all streams; timestamps are those of units that start in whole packets."""
    e = _found(*_read(spark, d), "timestamps").where("type not in ('TransportError')")
    return e.select("severity", "type", "pid", "packet_index", "code", F.round("arg1", 6).alias("arg1"))


@query
def eng_pid_summary(spark, d):
    p, c = _read(spark, d)
    return summary.pid_summary(p, _found(p, c), c).select(
        "pid", "packet_count", "payload_packets", "scrambled_payload_packets", "continuity_errors", "transport_errors", "error_count", "warning_count", "stream_name", "is_pcr_pid", "is_pmt_pid", F.round("share", 6).alias("share"))


@query
def eng_totals(spark, d):
    return summary.totals(_found(*_read(spark, d))).select("pid", F.col("level").cast("int").alias("level"), "errors", "warnings")


@query
def eng_merged(spark, d):
    return summary.coalesce(_found(*_read(spark, d))).select("severity", "type", "pid", "start_packet", "end_packet", "occurrences", F.round("arg1", 6).alias("arg1"))


@query
def eng_capped(spark, d):
    kept, omitted = summary.capped(summary.coalesce(_found(*_read(spark, d))), 100)
    return kept.crossJoin(omitted).select("type", "pid", "start_packet", "occurrences", "omitted")


@query
def eng_event_times(spark, d):
    p, c = _read(spark, d)
    e = summary.event_times(detect.transport_errors(p), detect.clock_rows(p, "pcr_base"), detect.clock_rows(p, "pts"), c)
    return e.select("pid", "packet_index", F.round("time_s", 6).alias("time_s"), F.round("source_time_s", 6).alias("source_time_s"))


@query
def eng_context(spark, d):
    merged = summary.coalesce(detect.transport_errors(packet.decode(stream(spark, d))))
    return summary.context_range(merged, 30.0, 10_000, 5.0).select("pid", "start_packet", "end_packet", "sample_start", "sample_end")


@query
def eng_bitrate(spark, d):
    p, c = _read(spark, d)
    return summary.bitrate(p, detect.clock_rows(p, "pcr_base"), c).select("pid", F.round("total_bitrate", 3).alias("total_bitrate"), F.round("bitrate", 3).alias("bitrate"))


@query
def eng_timeline(spark, d):
    p, c = _read(spark, d)
    return summary.timeline(p, detect.clock_rows(p, "pcr_base"), c, most=1 << 30).select(F.col("start_s").cast("long").alias("start_s"), "duration_s", F.round("total_packets", 3).alias("total_packets"))


@query
def eng_filter(spark, d):
    p, c = _read(spark, d)
    out = packet.decode(edit.filter_streams(p, c, {257, 258}))
    return out.groupBy("pid").agg(F.count(F.lit(1)).alias("packets"), F.sum("cc").alias("counters"), F.count("pcr_base").alias("clocks"))


@query
def eng_remap(spark, d):
    p, c = _read(spark, d)
    out = packet.decode(edit.remap(p, c, {256: 1000, 260: 1001})).where("pid >= 256 and pid <> 4096")
    out = seq.unwrap(out.select("pid", "cc", "packet_index", "pcr_base"), ["pid"], "packet_index", "pcr_base", out="clock", empty=True)
    return out.groupBy("pid").agg(F.count(F.lit(1)).alias("packets"), F.sum("cc").alias("counters"), F.sum("clock").alias("clocks"))


@query
def eng_extract(spark, d):
    p, c = _read(spark, d)
    es = edit.extract_elementary(p, detect.continuity_rows(p), list(range(256, 264)))
    return es.groupBy("pid").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("payload")).alias("bytes"))


@query
def eng_extract_totals(spark, d):
    p, c = _read(spark, d)
    return edit.extraction_totals(p, detect.continuity_rows(p), list(range(256, 264))).drop("path")


@query
def eng_damage_runs(spark, d):
    return navigate.damage_runs(packet.decode(stream(spark, d))).select("pid", "start_packet", "end_packet", "damaged", "last_cc", "next_cc", "missing")


@query
def eng_gaps(spark, d):
    p = packet.decode(stream(spark, d))
    return repair.gaps(detect.continuity_rows(p)).where("pid between 256 and 263").select("pid", "packet_index", "last_packet", "last_cc", "missing")


@query
def eng_large_gaps(spark, d):
    return repair.large_gaps(detect.clock_rows(packet.decode(stream(spark, d)), "pts")).select("pid", "last_packet", "packet_index", "start_t", "end_t", "delta")


def _file(spark, d) -> str:
    """The stream as a file in the shared folder, removed when the driver ends: one packet in 1000 without its sync byte, one a byte short."""
    path = f"{shared_folder(spark, 'stream')}/events.ts"
    k = F.pmod("packet_index", F.lit(1000))
    raw = F.when(k == 500, F.concat(F.lit(bytearray(1)), F.substring("raw", 2, 187))).when(k == 900, F.substring("raw", 1, 187)).otherwise(F.col("raw"))
    mpegts.write(stream(spark, d).withColumn("raw", raw), path)
    return path


@query
def eng_file_packets(spark, d):
    p = packet.decode(mpegts.read(spark, _file(spark, d), split_packets=777)).select("file_offset", "pid", "cc", "tei", "pcr_base", "pts")
    p = seq.unwrap(p, ["pid"], "file_offset", "pcr_base", out="clock", empty=True)
    p = seq.unwrap(p, ["pid"], "file_offset", "pts", out="stamp", empty=True)
    return p.select("file_offset", "pid", "cc", "tei", F.col("clock").alias("pcr_base"), F.col("stamp").alias("pts"))


@query
def eng_file_losses(spark, d):
    return mpegts.losses(spark, _file(spark, d), split_packets=777).select("start", "end")


TV = EV + """,
k0 as (select event_id, user_id % 8 + 256 as pid, event_type, sum(case when event_id % 97 = 0 then 2 else 1 end) over (partition by user_id % 8 order by event_id) as n from ev),
k as (select event_id + 2 as i, pid::int as pid, event_type = 'error' as tei, event_type = 'signup' as pusi, (pid = 256 or event_type = 'purchase') as clocked,
  (n % 16)::int as cc, event_id * 3000 as t from k0),
tei as (select * from k where tei),
s0 as (select *, sum(tei::int) over (partition by pid order by i) as cut from k),
s as (select *, lag(cc) over (partition by pid, cut order by i) as was from s0 where not tei),
f as (select *, (was is not null and (cc - was + 31) % 16 <> 0) as gap, (cc - was + 31) % 16 as missing from s),
q as (select pid, i, t, t - lag(t) over (partition by pid order by i) as dt from k where clocked and not tei),
e as (select 'Error' as severity, 'TransportError' as type, pid, i, 'TransportError' as code, null::double as arg1, null::double as arg2, null::double as arg3 from tei
  union all select 'Error', 'ContinuityGap', pid, i, 'ContinuityGap', ((was + 1) % 16)::double, cc::double, missing::double from f where gap
  union all select case when dt > 900000 then 'Error' else 'Warning' end, case when dt > 900000 then 'PcrJump' else 'PcrGap' end, pid, i,
    case when dt > 900000 then 'PcrJump' else 'PcrGap' end, round(dt / 90000.0::double, 6), null, null from q where dt > 45000),
m0 as (select *, lag(i) over (partition by severity, type, pid order by i) as last_i from e),
m1 as (select *, sum((last_i is null or i - last_i > 256)::int) over (partition by severity, type, pid order by i) as run from m0),
m as (select severity, type, pid, min(i) as start_packet, max(i) as end_packet, count(*)::bigint as occurrences, min_by(arg1, i) as arg1 from m1 group by severity, type, pid, run),
p as (select pid, i, t, t - lag(t) over (partition by pid order by i) as dt, lag(i) over (partition by pid order by i) as last_i, lag(t) over (partition by pid order by i) as last_t from k where pusi)"""

ORACLES: dict[str, str] = {
    "eng_catalog": """select 1 as program_number, 4096 as pmt_pid, 256 as pcr_pid, 7 as tsid, 3 as pat_version, pid::int as pid, case when pid = 256 then 27 else 15 end as stream_type,
        case when pid = 256 then 'H264' else 'Aac' end as stream_name from range(256, 264) r(pid)""",
    "eng_events": f"with {TV} select severity, type, pid, i as packet_index, i * 188 as file_offset, code, arg1, arg2, arg3 from e",
    "eng_timestamp_events": f"""with {TV} select case when dt > 900000 then 'Error' else 'Warning' end as severity, case when dt > 900000 then 'PtsJump' else 'StreamGap' end as type, pid, i as packet_index,
        case when dt > 900000 then 'PtsJump' else 'AudioGap' end as code, round(dt / 90000.0::double, 6) as arg1 from p where dt > 900000 or (pid <> 256 and dt > 180000)""",
    "eng_pid_summary": f"""with {TV}, a as (select pid, count(*) as packet_count, count(*) filter (not tei) as payload_packets from k group by pid union all select 0, 1, 1 union all select 4096, 1, 1),
        x as (select pid, count(*) filter (type = 'ContinuityGap') as ce, count(*) filter (type = 'TransportError') as te, count(*) filter (severity = 'Error') as ee, count(*) filter (severity = 'Warning') as ww from e group by pid)
        select a.pid::int as pid, packet_count::bigint as packet_count, payload_packets::bigint as payload_packets, 0::bigint as scrambled_payload_packets, coalesce(ce, 0)::bigint as continuity_errors, coalesce(te, 0)::bigint as transport_errors,
        coalesce(ee, 0)::bigint as error_count, coalesce(ww, 0)::bigint as warning_count, case when a.pid = 256 then 'H264' when a.pid between 257 and 263 then 'Aac' end as stream_name, a.pid = 256 as is_pcr_pid, a.pid = 4096 as is_pmt_pid,
        round(packet_count * 100.0::double / (select sum(packet_count) from a), 6) as share from a left join x on a.pid = x.pid""",
    "eng_totals": f"""with {TV} select pid, case when grouping(pid) = 1 then 1 else 0 end as level, count(*) filter (severity = 'Error') as errors, count(*) filter (severity = 'Warning') as warnings
        from e group by grouping sets ((pid), ())""",
    "eng_merged": f"with {TV} select severity, type, pid, start_packet, end_packet, occurrences, arg1 from m",
    "eng_capped": f"""with {TV}, x as (select * from m order by start_packet, type, pid limit 100)
        select type, pid, start_packet, occurrences, ((select sum(occurrences) from m) - (select sum(occurrences) from x))::bigint as omitted from x""",
    "eng_event_times": f"""with {TV}, w as (select pid, i, tei, last_value(case when clocked and not tei and pid = 256 then t end ignore nulls) over a as own,
          last_value(case when clocked and not tei then t end ignore nulls) over a as most, last_value(case when pusi then t end ignore nulls) over (partition by pid order by i) as pts
          from k window a as (order by i)), o as (select min_by(t, i) as origin from k where (clocked and not tei) or pusi)
        select pid, i as packet_index, case when coalesce(own, most, pts) is not null then round(greatest(0, coalesce(own, most, pts) - origin) / 90000.0::double, 6) end as time_s, round(coalesce(own, most, pts) / 90000.0::double, 6) as source_time_s from w, o where tei""",
    "eng_context": f"""with {TV} select pid, start_packet, end_packet, greatest(0, start_packet - 150) as sample_start, least(10000, end_packet + 150) as sample_end from m where type = 'TransportError'""",
    "eng_bitrate": f"""with {TV}, r0 as (select *, sum((dt is null or dt <= 0 or dt > 90000)::int) over (order by i) as run from q where pid = 256),
        r1 as (select run, max(t) - min(t) as ticks, max(i) - min(i) as n, min(i) as a from r0 group by run having max(t) - min(t) >= 45000),
        r as (select n * 188 * 8 * 90000.0::double / ticks as rate from r1 order by ticks desc, a limit 1), a as (select pid, count(*) as n from k group by pid union all select 0, 1 union all select 4096, 1)
        select a.pid::int as pid, round(rate, 3) as total_bitrate, round(rate * n / (select sum(n) from a), 3) as bitrate from a, r""",
    "eng_timeline": f"""with {TV}, v as (select i as a, lead(i) over (order by i) as b, t, lead(t) over (order by i) as tb from q where pid = 256),
        z as (select a, b, (t - (select min(t) from q where pid = 256)) / 90000.0::double as lo, (tb - (select min(t) from q where pid = 256)) / 90000.0::double as hi from v where b is not null),
        n as (select z.a, lo, hi, count(*) as n from z join k on k.i >= z.a and k.i < z.b group by z.a, lo, hi),
        u as (select *, unnest(range(floor(lo)::bigint, greatest(floor(lo), ceil(hi) - 1)::bigint + 1)) as bucket from n)
        select bucket as start_s, 1.0::double as duration_s, round(sum(n * (least(hi, bucket + 1) - greatest(lo, bucket)) / (hi - lo)), 3) as total_packets from u group by bucket""",
    "eng_filter": f"""with {TV} select pid, count(*) as packets, sum(cc)::bigint as counters, count(*) filter (clocked) as clocks from k where pid in (257, 258) group by pid
        union all select 256, count(*), sum(cc)::bigint, count(*) from k where pid = 256 and not tei union all select 0, 1, 0, 0 union all select 4096, 1, 0, 0""",
    "eng_remap": f"""with {TV} select case when pid = 256 then 1000 else 1001 end as pid, count(*) as packets, sum(cc)::bigint as counters, sum(case when clocked then t end)::bigint as clocks
        from k where pid in (256, 260) group by k.pid""",
    "eng_extract": f"""with {TV}, g as (select k.*, f.gap from k left join f on f.i = k.i), h as (select *, last_value(case when pusi and not tei then 1 when tei or gap then 0 end ignore nulls) over (partition by pid order by i) as good from g)
        select pid, count(*) as packets, sum(184 - case when clocked then 8 else 0 end - case when pusi then 14 else 0 end)::bigint as bytes from h where good = 1 and not tei group by pid""",
    "eng_extract_totals": f"""with {TV}, a as (select pid, count(*) filter (tei) as te from k group by pid), b as (select pid, count(*) filter (gap) as ce from f group by pid)
        select a.pid, te as transport_errors, ce as continuity_errors, 0::bigint as invalid, 0::bigint as scrambled, 0::bigint as duplicates, te + ce as anomalies from a join b on a.pid = b.pid""",
    "eng_damage_runs": f"""with {TV}, w as (select *, sum((not tei)::int) over (partition by pid order by i) as sound, last_value(case when not tei then cc end ignore nulls) over (partition by pid order by i rows between unbounded preceding and 1 preceding) as last_cc from k),
        r as (select pid, sound, min(i) as start_packet, max(i) as end_packet, count(*) as damaged, any_value(last_cc) as last_cc from w where tei group by pid, sound),
        x as (select r.pid, start_packet, end_packet, damaged, r.last_cc, n.cc as next_cc, (n.cc - r.last_cc + 31) % 16 as missing from r join w n on n.pid = r.pid and not n.tei and n.sound = r.sound + 1)
        select * from x where last_cc is not null and (missing > 0 or damaged >= 16)""",
    "eng_gaps": f"""with {TV}, w as (select *, lag(i) over o as last_packet, lag(cc) over o as last_cc, row_number() over o as nth, count(*) over (partition by pid) as total from f window o as (partition by pid order by i))
        select pid, i as packet_index, last_packet, last_cc, missing from w where gap and nth > 4 and nth <= total - 3""",
    "eng_large_gaps": f"""with {TV}, w as (select *, list_sort(list_filter(list(case when dt > 0 and dt <= 90000 then dt end) over (partition by pid order by i rows between 31 preceding and 1 preceding), lambda x: x is not null)) as l from p)
        select pid, last_i as last_packet, i as packet_index, last_t as start_t, t as end_t, dt as delta from w where dt > 90000 and dt > 4 * l[len(l) // 2 + 1] and dt <= 54000000""",
    "eng_file_packets": f"""with {TV}, a as (select 0 as i, 0 as pid, 0 as cc, false as tei, null::bigint as clock, null::bigint as pts union all select 1, 4096, 0, false, null, null union all select i, pid, cc, tei, case when clocked then t end, case when pusi then t end from k)
        select i * 188 - (i + 99) // 1000 as file_offset, pid, cc, tei, clock as pcr_base, pts from a where i % 1000 not in (500, 901)""",
    "eng_file_losses": f"""with {TV}, a as (select i, i * 188 - (i + 99) // 1000 as o from k)
        select o as start, o + 188 as "end" from a where i % 1000 = 500 union all select o + 188, o + 375 from a where i % 1000 = 900""",
}
