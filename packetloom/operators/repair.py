"""Repair: clock segments of one file, and joins of a damaged reference with donors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators import seq

STEP = 22_500
WINDOW = 120 * 90_000
SEGMENTS = "path string, pid int, kind string, start_packet long, end_packet long, start_t long, end_t long, error double"


def _plan(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("packet_index")
    n, t, cut = f.packet_index.tolist(), f.t.tolist(), f.clock_segment.tolist()
    steps = [(i, n[i] - n[i - 1], t[i] - t[i - 1]) for i in range(1, len(n)) if cut[i] == cut[i - 1]]
    rates = sorted(d / k for _, k, d in steps if k > 0 and 0 < d < 45_000)
    out: list[tuple] = []
    if len(rates) >= 3:
        rate = rates[len(rates) // 2]
        errors = {i: d - k * rate for i, k, d in steps}
        bounds = [i for i, e in errors.items() if abs(e) >= STEP]
        used: set[int] = set()

        def add(kind: str, a: int, b: int | None, e: float) -> None:
            out.append((f.path.iloc[0], int(f.pid.iloc[0]), kind, n[a], None if b is None else n[b], t[a], None if b is None else t[b], e))

        for x, i in enumerate(bounds):
            if i in used:
                continue
            used.add(i)
            e = errors[i]
            pair = next((j for j in bounds[x + 1 :] if j not in used and t[j] - e - t[i] <= WINDOW and e * errors[j] < 0 and abs(e + errors[j]) <= max(9000, abs(e) * 0.05)), None)
            if pair is not None:
                used.add(pair)
                add("TemporaryPcrOffset", i, pair, e)
                continue
            total, start = 0.0, None
            for j in range(i - 1, 0, -1):
                if j not in errors or j in bounds or t[i - 1] - t[j] > WINDOW:
                    break
                total += errors[j]
                if i - j >= 20 and abs(total + e) <= max(9000, abs(e) * 0.1):
                    start = j
                    break
            if start is not None:
                add("GradualPcrDrift", start, i, -e)
            else:
                add("PersistentClockDiscontinuity", i, None, e)
    return pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])


def timeline_segments(pcr: DataFrame) -> DataFrame:
    """Faulty stretches of each clock: offsets that return, drifts that jump back, steps that last. A fold over clock samples only.

    The correction of an offset or step is ``-error`` from its start on; that of a drift grows from 0 to ``-error`` at its end."""
    return pcr.select("path", "pid", "packet_index", "t", "clock_segment").groupBy("path", "pid").applyInPandas(_plan, SEGMENTS)


def corrections(p: DataFrame, segments: DataFrame, c) -> DataFrame:
    """``clock`` and ``stamps``: ticks to add to each packet's clock and timestamps. Segments of a clock hold for all streams of its programs and add up."""
    carriers = c.programs.select("path", F.col("pcr_pid").alias("pid"), "program_number").distinct()
    own = carriers.join(c.streams.select("path", "program_number", F.col("pid").alias("stream")).distinct(), ["path", "program_number"]).select("path", "pid", "stream")
    reach = own.unionByName(segments.select("path", "pid", F.col("pid").alias("stream"))).distinct()
    plan = segments.join(reach, ["path", "pid"]).groupBy("path", F.col("stream").alias("pid")).agg(F.collect_list(F.struct("kind", "start_packet", "end_packet", "error")).alias("__plan"))
    rows = p.join(F.broadcast(plan), ["path", "pid"], "left").withColumn("clock", _move(F.col("__plan")))  # a row for each stream
    return rows.withColumn("stamps", F.col("clock")).drop("__plan")


def _move(plan) -> Column:
    """The ticks that a list of segments moves what stands at ``packet_index`` by."""
    def add(total: Column, s: Column) -> Column:
        here = (F.col("packet_index") >= s["start_packet"]) & (s["end_packet"].isNull() | (F.col("packet_index") < s["end_packet"]))
        share = F.when(s["kind"] == "GradualPcrDrift", (F.col("packet_index") - s["start_packet"]) / (s["end_packet"] - s["start_packet"])).otherwise(F.lit(1.0))
        return total + F.when(here, -s["error"] * share).otherwise(F.lit(0.0))

    return F.coalesce(F.round(F.aggregate(plan, F.lit(0.0), add)).cast("long"), F.lit(0).cast("long"))


def normalised(rows: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """Rows (path, packet_index) of gaps, units, samples or anchors whose times in ``columns`` are those of the corrected timeline of their file's clock."""
    plan = segments.groupBy("path").agg(F.collect_list(F.struct("kind", "start_packet", "end_packet", "error")).alias("__plan"))
    rows = rows.join(F.broadcast(plan), "path", "left").withColumn("__move", _move(F.col("__plan")))
    return rows.withColumns({c: F.col(c) + F.col("__move") for c in columns}).drop("__plan", "__move")


def _payloads(faults: DataFrame) -> DataFrame:
    """Payload packets with their place in the PID, payload hash and stretch without damage."""
    rows = faults.where("fault is null or fault = 'Gap'").withColumn("h", F.xxhash64(F.expr("substring(raw, payload_offset + 1, 184)")))
    rows = seq.scan(rows, ["path", "pid"], "packet_index", sums={"nth": F.lit(1).cast("long"), "stretch": (F.coalesce(F.col("fault") == "Gap", F.lit(False)) | F.col("discontinuity")).cast("long")})
    return rows.select("path", "pid", "packet_index", "cc", "h", "nth", "stretch", "fault", "missing", "raw")


def gaps(faults: DataFrame) -> DataFrame:
    """Counter gaps with four payload hashes before and after: (path, pid, packet_index, missing, before, after, last_cc)."""
    from pyspark.sql import Window

    rows = _payloads(faults)
    w = Window.partitionBy("path", "pid").orderBy("nth")
    side = lambda lo, hi: F.collect_list("h").over(w.rowsBetween(lo, hi))
    rows = rows.withColumns({"before": side(-4, -1), "after": side(0, 3), "last_cc": F.lag("cc").over(w), "last_packet": F.lag("packet_index").over(w)})
    return rows.where("fault = 'Gap' and size(before) = 4 and size(after) = 4").select("path", "pid", "packet_index", "last_packet", "last_cc", "missing", F.xxhash64("before").alias("before"), F.xxhash64("after").alias("after"))


def gap_candidates(reference: DataFrame, donor: DataFrame, tracks: DataFrame, longest: int = 256) -> DataFrame:
    """Donor stretches between the anchors of reference gaps: undamaged, at most ``longest`` packets, of a count that fits the counters.

    ``tracks`` maps (pid, donor_path, donor_pid). Both anchors are equi-joins on four payload hashes."""
    from pyspark.sql import Window

    rows = _payloads(donor)
    w = Window.partitionBy("path", "pid").orderBy("nth")
    grams = rows.withColumns({"gram": F.xxhash64(F.collect_list("h").over(w.rowsBetween(0, 3))), "__last": F.lead("stretch", 3).over(w)}).where("__last = stretch")
    grams = grams.select(F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), "nth", "stretch", "gram")
    g = reference.join(F.broadcast(tracks), "pid")
    start = g.join(grams.withColumnRenamed("gram", "before"), ["donor_path", "donor_pid", "before"]).withColumn("first", F.col("nth") + 4).drop("nth", "before")
    end = grams.select("donor_path", "donor_pid", F.col("gram").alias("after"), F.col("nth").alias("stop"), F.col("stretch").alias("__s"))
    found = start.join(end, ["donor_path", "donor_pid", "after"]).where("stretch = __s").withColumn("n", F.col("stop") - F.col("first"))
    return found.where(f"n > 0 and n <= {longest} and n % 16 = missing").select("path", "pid", "packet_index", "last_packet", "last_cc", "missing", "donor_path", "donor_pid", "first", "n")


def choose(candidates: DataFrame, donor_errors: DataFrame) -> DataFrame:
    """One candidate per gap: the donor with the fewest errors, then its order by path, then the earliest place."""
    c = candidates.join(F.broadcast(donor_errors), "donor_path", "left").na.fill(0, ["errors"])
    return seq.best(c, ["path", "pid", "packet_index"], [F.col("errors"), F.col("donor_path"), F.col("first")], ["last_packet", "last_cc", "donor_path", "donor_pid", "first", "n"])


def insertions(chosen: DataFrame, donor: DataFrame) -> DataFrame:
    """Donor packets at their places in the reference, under the reference's PID and counters: (packet_index, sub_index, raw)."""
    from packetloom.operators.edit import renumbered, with_header

    rows = _payloads(donor).select(F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), "nth", "raw")
    places = chosen.select("pid", "last_packet", "last_cc", "donor_path", "donor_pid", "first", F.explode(F.expr("sequence(0, n - 1)")).alias("k")).withColumn("nth", F.col("first") + F.col("k"))
    rows = places.join(rows, ["donor_path", "donor_pid", "nth"])
    header = F.conv(F.hex(F.substring("raw", 1, 4)), 16, 10).cast("long")
    cc = F.pmod(F.col("last_cc") + 1 + F.col("k"), F.lit(16))
    return rows.select(F.col("last_packet").alias("packet_index"), (F.col("k") + 1).cast("int").alias("sub_index"), with_header(F.col("raw"), renumbered(header, F.col("pid"), cc)).alias("raw"))


def track_mapping(reference: DataFrame, donor: DataFrame) -> DataFrame:
    """Donor tracks of each reference track: same type and supplement, languages equal but for case or missing (blank).

    Catalog rows (path, program_number, pid, stream_type, supplement, language). Where one candidate has the track's own PID and program, it alone
    counts; else all stay, for fingerprints to tell, ranked by program, PID, number. ``ambiguous`` if a track has several partners either way."""
    from pyspark.sql import Window

    spoken = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    a = reference.select("pid", "program_number", "stream_type", "supplement", spoken("language").alias("language")).distinct()
    b = donor.select(F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), F.col("program_number").alias("dp"), F.col("stream_type").alias("dt"), F.col("supplement").alias("ds"), spoken("language").alias("dl")).distinct()
    m = a.join(F.broadcast(b), (F.col("stream_type") == F.col("dt")) & F.col("supplement").eqNullSafe(F.col("ds")) & (F.col("language").isNull() | F.col("dl").isNull() | (F.col("language") == F.col("dl"))))
    direct = (F.col("pid") == F.col("donor_pid")) & (F.col("program_number") == F.col("dp"))
    of = Window.partitionBy("donor_path", "pid")
    m = m.withColumn("__direct", direct).withColumn("__one", F.sum(direct.cast("int")).over(of) == 1).where("not __one or __direct")
    order = [F.col("program_number") != F.col("dp"), F.col("pid") != F.col("donor_pid"), F.col("donor_pid"), F.col("dp")]
    m = m.withColumns({"rank": F.row_number().over(of.orderBy(*order)), "__forth": F.count(F.lit(1)).over(of), "__back": F.count(F.lit(1)).over(Window.partitionBy("donor_path", "donor_pid"))})
    return m.select("pid", "donor_path", "donor_pid", "rank", ((F.col("__back") > 1) | (F.col("__forth") > 1)).alias("ambiguous"))


def time_offset(reference: DataFrame, donor: DataFrame, least: int = 3) -> DataFrame:
    """(pid, donor_path, offset): the upper median of the largest cluster of timestamp differences of units with equal signatures."""
    a = reference.where("pts is not null").select("pid", "signature", "pts")
    b = donor.where("pts is not null").select(F.col("path").alias("donor_path"), "signature", F.col("pts").alias("dpts"))
    j = a.join(b, "signature").withColumn("off", F.col("pts") - F.col("dpts")).withColumn("cluster", F.bround(F.col("off") / 9000.0, 0))
    g = j.groupBy("pid", "donor_path", "cluster").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("off"), 0.5).alias("mid"), F.min(F.struct(F.lit(0), "off")).alias("low")).where(F.col("n") >= least)
    best = seq.best(g, ["pid", "donor_path"], [-F.col("n"), F.col("cluster")], ["cluster", "n"])
    near = j.join(best.drop("n"), ["pid", "donor_path", "cluster"]).groupBy("pid", "donor_path", "off").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy("pid", "donor_path")
    upto = F.sum("k").over(w.orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
    # the upper median from counts per value: nothing is gathered into lists
    return near.withColumns({"upto": upto, "total": F.sum("k").over(w)}).where("upto > floor(total / 2)").groupBy("pid", "donor_path").agg(F.min("off").alias("offset"))


def pes_units(p: DataFrame, elementary: DataFrame) -> DataFrame:
    """One row per PES unit: start, timestamp, packets, bytes and an order-aware signature of its elementary bytes."""
    starts = p.where("pusi and has_payload and not tei and parse_error is null").select("path", "pid", "packet_index", F.struct("packet_index", "pts").alias("start"))
    rows = seq.asof(elementary, starts, ["path", "pid"], "packet_index", "start", "u").where("u is not null")
    place = F.col("packet_index") - F.col("u.packet_index")
    return rows.groupBy("path", "pid", "u").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("payload")).alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.hex("payload").alias("x")))), lambda s: s["x"]), ""), 256).alias("signature"),
    ).select("path", "pid", F.col("u.packet_index").alias("packet_index"), F.col("u.pts").alias("pts"), "packets", "bytes", "signature")


def large_gaps(pts: DataFrame, longest_s: int = 600) -> DataFrame:
    """Timestamp steps over a second and over four times the upper median of the last 31 normal steps."""
    from pyspark.sql import Window

    normal = F.when((F.col("delta") > 0) & (F.col("delta") <= 90_000), F.col("delta"))
    frame = F.collect_list(normal).over(Window.partitionBy("path", "pid", "clock_segment").orderBy("packet_index").rowsBetween(-31, -1))
    rows = pts.withColumn("median", seq.upper_median(frame))
    return rows.where(f"delta > 90000 and delta > 4 * median and delta <= {longest_s * 90_000}").select("path", "pid", F.col("last_packet"), "packet_index", F.col("last_t").alias("start_t"), F.col("t").alias("end_t"), "delta")


def correlate(gaps_: DataFrame, video_pids: list[int], reach: int = 90_000) -> DataFrame:
    """Gaps of other PIDs whose two ends are within ``reach`` of a video gap's: the nearest one of each PID."""
    video = gaps_.where(F.col("pid").isin(video_pids)).select("path", F.col("pid").alias("video_pid"), F.col("start_t").alias("vs"), F.col("end_t").alias("ve"))
    m = seq.band_join(video, gaps_.where(~F.col("pid").isin(video_pids)), ["path"], "vs", "start_t", reach).where(F.abs(F.col("ve") - F.col("end_t")) <= reach)
    return seq.best(m, ["path", "video_pid", "vs", "pid"], [F.abs(F.col("vs") - F.col("start_t")) + F.abs(F.col("ve") - F.col("end_t")), F.col("start_t")], ["start_t", "end_t"])


def incidents(faults: DataFrame, healthy: int = 2 * 90_000) -> DataFrame:
    """Faults (path, pid, t) with less than ``healthy`` ticks between them are one incident: its span and PIDs."""
    rows = faults.groupBy("path", "t").agg(F.collect_set("pid").alias("pids")).withColumn("end_t", F.col("t"))
    rows = seq.scan(rows, ["path"], "t", lags={"__was": F.col("t")})
    rows = seq.scan(rows, ["path"], "t", sums={"__run": (F.col("__was").isNull() | (F.col("t") - F.col("__was") > healthy)).cast("long")})
    return rows.groupBy("path", "__run").agg(F.min("t").alias("start_t"), F.max("end_t").alias("end_t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pids")))).alias("pids")).drop("__run")


def improved(before: DataFrame, after: DataFrame, repairs: int) -> bool:
    """Whether an output may be kept: fewer errors than before, or none in both and something repaired."""
    a, b = (e.where("severity = 'Error'").count() for e in (before, after))
    return b < a or a == b == 0 and repairs > 0
