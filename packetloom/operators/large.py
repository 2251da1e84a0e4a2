"""Large holes and damaged regions of a reference, filled from donors.

A large gap is found in a donor by the signatures of four PES units on each side of it; the donor's stretch between them is copied per track, under the
reference's PID, in the reference's time and with counters that run on. Regions are replaced packet for packet, in proportion. Tables of gaps, candidates and
plan items are as large as the damage; packets meet them by keys or as-of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import edit, seq

ANCHORS, TOLERANCE, HOLE = 4, 18_000, 90_000
MASK = 1 << 33
GAP = ["path", "pid", "packet_index"]


def _signed(ticks: Column) -> Column:
    """A difference of 33-bit clocks as the nearest number."""
    return F.pmod(ticks + (MASK >> 1), F.lit(MASK)) - (MASK >> 1)


def anchored(units: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """PES units (path, pid, packet_index, pts, signature) with hashes of the ``anchors`` signatures up to each (``before``) and from it on (``after``)."""
    w = Window.partitionBy("path", "pid").orderBy("packet_index")
    side = lambda a, b: F.collect_list("signature").over(w.rowsBetween(a, b))
    rows = units.withColumns({"__b": side(1 - anchors, 0), "__a": side(0, anchors - 1), "next_packet": F.lead("packet_index").over(w), "step": _signed(F.col("pts") - F.lag("pts").over(w))})
    whole = lambda c: F.when(F.size(c) == anchors, F.xxhash64(c))
    return rows.withColumns({"before": whole("__b"), "after": whole("__a")}).drop("__a", "__b")


def candidates(gaps: DataFrame, reference: DataFrame, donor: DataFrame, tracks: DataFrame, faults: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Donor stretches for large gaps (see :func:`repair.large_gaps`): both anchors there, durations alike, no damage and no hole of a second inside.

    ``reference`` and ``donor``: units of :func:`repair.pes_units`; ``tracks``: (pid, donor_path, donor_pid); ``faults``: damaged donor packets (path, pid,
    packet_index). The stretch is [first, stop) in donor packets; ``offset`` are the ticks from donor to reference time."""
    own, other = anchored(reference), anchored(donor)
    g = gaps.join(own.select("path", "pid", F.col("packet_index").alias("last_packet"), "before"), ["path", "pid", "last_packet"])
    g = g.join(own.select("path", "pid", "packet_index", "after"), GAP).join(F.broadcast(tracks), "pid")  # as many tracks as the catalog has
    side = lambda gram, **names: other.where(F.col(gram).isNotNull()).select(F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), gram, *[F.col(c).alias(n) for n, c in names.items()])
    m = g.join(side("before", __last="packet_index", first="next_packet", __t0="pts"), ["donor_path", "donor_pid", "before"])
    m = m.join(side("after", stop="packet_index", __t1="pts"), ["donor_path", "donor_pid", "after"]).where("stop >= first and __last < stop")
    m = m.where(F.abs(_signed(F.col("__t1") - F.col("__t0")) - F.col("delta")) <= tolerance)
    at = [F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), F.col("packet_index").alias("__at")]
    inside = ["donor_path", "donor_pid"]
    # damage between the anchors, and steps of the clock that are holes themselves, rule a stretch out
    bad = faults.select(*at).unionByName(other.where((F.col("step") > HOLE) | (F.col("step") < 0)).select(*at)).distinct()
    hurt = m.select(*GAP, *inside, "first", "stop").join(bad, inside).where("__at >= first and __at <= stop").select(*GAP, *inside, "first").distinct()
    m = m.join(hurt, [*GAP, *inside, "first"], "left_anti")
    return m.select(*GAP, "last_packet", "start_t", "end_t", "delta", *inside, "first", "stop", _signed(F.col("start_t") - F.col("__t0")).alias("offset"))


def choose(found: DataFrame, donor_errors: DataFrame, reach: int = HOLE) -> DataFrame:
    """One stretch per gap. Gaps that begin within ``reach`` ticks are one incident; its donor is the one with the most tracks of it, then the fewest
    errors, then the first by path; of its stretches the first one counts."""
    rows = seq.scan(found.select("path", "start_t").distinct(), ["path"], "start_t", lags={"__was": F.col("start_t")})
    rows = seq.scan(rows, ["path"], "start_t", sums={"incident": (F.col("__was").isNull() | (F.col("start_t") - F.col("__was") > reach)).cast("long")}).drop("__was")
    c = found.join(rows, ["path", "start_t"]).join(F.broadcast(donor_errors), "donor_path", "left").na.fill(0, ["errors"])
    per = c.groupBy("path", "incident", "donor_path").agg(F.countDistinct("pid").alias("tracks"), F.min("errors").alias("errors"))
    best = seq.best(per, ["path", "incident"], [-F.col("tracks"), F.col("errors"), F.col("donor_path")], ["donor_path"])
    c = c.join(best, ["path", "incident", "donor_path"])
    return seq.best(c, GAP, [F.col("first"), F.col("donor_pid")], ["last_packet", "start_t", "end_t", "incident", "donor_path", "donor_pid", "first", "stop", "offset"])


def _placed(items: DataFrame, donor: DataFrame) -> DataFrame:
    """Decoded donor packets of the items' stretches, in reference time and under the reference's PID, with their place ``k`` from 1 and number ``n``."""
    d = donor.where("not tei").withColumnsRenamed({"path": "donor_path", "pid": "donor_pid", "packet_index": "__at"})
    rows = items.withColumnRenamed("packet_index", "__slot").join(d, ["donor_path", "donor_pid"]).where("__at >= first and __at < stop")
    of = Window.partitionBy("path", "pid", "__slot")
    rows = rows.withColumns({"k": F.row_number().over(of.orderBy("__at")), "n": F.count(F.lit(1)).over(of), "packet_index": F.col("__at")})
    rows = edit.shift_timestamps(rows, "offset", "offset")
    header = edit.renumbered(F.col("header"), F.col("pid"))
    return rows.withColumns({"raw": edit.with_header(F.col("raw"), header), "header": header})


_COLUMNS = ["path", "pid", "seg", "packet_index", "sub_index", "has_payload", "tei", "cc", "header", "raw"]


def _marked(p: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets with ``seg``, two for each item of their PID that begins at or before them, and the items with their number ``nth``."""
    order = Window.partitionBy("path", "pid").orderBy("packet_index")
    items = items.withColumn("nth", F.row_number().over(order))
    rows = seq.asof(p, items.select(*GAP, F.col("nth").cast("long").alias("nth")), ["path", "pid"], "packet_index", "nth", "seg")
    return rows.withColumn("seg", F.coalesce("seg", F.lit(0)) * 2), items


def insert(p: DataFrame, chosen: DataFrame, donor: DataFrame) -> DataFrame:
    """The reference with the chosen stretches before the packets at which its gaps end: (packet_index, sub_index, raw). What the reference has of a
    track inside a gap, damaged packets, is left out; the counters of a track run on over all seams."""
    rows, items = _marked(p, chosen)
    held = items.select("path", "pid", "nth", F.col("last_packet").alias("__a"), F.col("packet_index").alias("__b"))
    inside = rows.where("tei").join(held, ["path", "pid"]).where("packet_index > __a and packet_index < __b").select(*GAP)
    rows = rows.join(inside, GAP, "left_anti").withColumn("sub_index", F.lit(0))
    more = _placed(items, donor).withColumns({"packet_index": F.col("__slot"), "sub_index": F.col("k") - F.col("n") - 1, "seg": (F.col("nth") * 2 - 1).cast("long")})
    return edit.joined_counters(rows.select(_COLUMNS).unionByName(more.select(_COLUMNS)))


def replace(p: DataFrame, regions: DataFrame, donor: DataFrame) -> DataFrame:
    """The reference with regions (path, pid, start_packet, end_packet, donor_path, donor_pid, first, stop, offset) replaced by the donor's packets, spread over
    the region's own places in proportion: (packet_index, sub_index, raw). Counters run on over the seams."""
    rows, items = _marked(p, regions.withColumnRenamed("start_packet", "packet_index"))
    spans = items.select("path", "pid", F.col("packet_index").alias("__slot"), "end_packet")
    hit = rows.join(spans, ["path", "pid"]).where("packet_index >= __slot and packet_index < end_packet").select(*GAP, "__slot")
    of = Window.partitionBy("path", "pid", "__slot")
    slots = hit.withColumns({"seen": F.row_number().over(of.orderBy("packet_index")).cast("long"), "__all": F.count(F.lit(1)).over(of)})
    sizes = slots.select("path", "pid", "__slot", "__all").distinct()
    more = _placed(items, donor).drop("packet_index").join(sizes, ["path", "pid", "__slot"])
    # the first place by which as many donor packets are due
    more = more.withColumn("seen", F.floor((F.col("k") - 1) * F.col("__all") / F.col("n")) + 1)
    more = more.join(slots.drop("__all"), ["path", "pid", "__slot", "seen"]).withColumns({"sub_index": F.col("k"), "seg": (F.col("nth") * 2 - 1).cast("long")})
    rows = rows.join(hit.select(*GAP), GAP, "left_anti").withColumn("sub_index", F.lit(0))
    return edit.joined_counters(rows.select(_COLUMNS).unionByName(more.select(_COLUMNS)))


def best_region(found: DataFrame, donor_errors: DataFrame) -> DataFrame:
    """One candidate per damaged region (pid, region_id, donor_path, donor_pid, start_packet, end_packet, matches): most matches, fewest errors, donor order."""
    c = found.join(F.broadcast(donor_errors), "donor_path", "left").na.fill(0, ["errors"])
    return seq.best(c, ["pid", "region_id"], [-F.col("matches"), F.col("errors"), F.col("donor_path"), F.col("start_packet")], ["donor_path", "donor_pid", "start_packet", "end_packet"])


def best_window(found: DataFrame) -> DataFrame:
    """One elementary window per gap (path, pid, gap_id, time_distance, packet_distance, donor_path, at): nearest in time, then in number of packets."""
    return seq.best(found, ["path", "pid", "gap_id"], [F.abs("time_distance"), F.abs("packet_distance"), F.col("donor_path"), F.col("at")], ["donor_path", "at", "time_distance", "packet_distance"])


def differing(reference: DataFrame, donor: DataFrame) -> DataFrame:
    """Windows of units (window, nth, signature; nth from 1) without what both begin and end with: (window, first, last, donor_first, donor_last), all null where they
    are equal; an empty side has last = first - 1."""
    size = lambda df, n: df.groupBy("window").agg(F.max("nth").alias(n))
    ends = size(reference, "__r").join(size(donor, "__d"), "window", "full").na.fill(0, ["__r", "__d"])
    both = lambda key: (
        reference.join(ends, "window").select("window", key("__r").alias("k"), F.col("signature").alias("a"))
        .join(donor.join(ends, "window").select("window", key("__d").alias("k"), F.col("signature").alias("b")), ["window", "k"], "full"))
    apart = ~F.col("a").eqNullSafe(F.col("b"))
    head = both(lambda n: F.col("nth")).where(apart).groupBy("window").agg(F.min("k").alias("__h"))
    tail = both(lambda n: F.col(n) - F.col("nth")).where(apart).groupBy("window").agg(F.min("k").alias("__t"))
    cut = ends.join(head, "window", "left").join(tail, "window", "left")
    # where the two ends would meet, the tail gives way
    keep = F.least("__t", F.least("__r", "__d") - F.col("__h") + 1)
    return cut.select("window", F.col("__h").alias("first"), (F.col("__r") - keep).alias("last"), F.when(F.col("__h").isNotNull(), F.col("__h")).alias("donor_first"), (F.col("__d") - keep).alias("donor_last"))


def status(issues: DataFrame, items: DataFrame) -> DataFrame:
    """What becomes of each issue (path, pid, issue_id, start_packet, end_packet) under plan items of the same shape (item_id): Repaired if one item holds it
    whole, PartlyRepaired if one overlaps it, else Open; with the first such item."""
    i = items.select("path", "pid", "item_id", F.col("start_packet").alias("__a"), F.col("end_packet").alias("__b"))
    m = issues.join(i, ["path", "pid"], "left").where("__a is null or __a <= end_packet and __b >= start_packet")
    m = m.withColumn("__rank", F.when(F.col("__a").isNull(), 2).when((F.col("__a") <= F.col("start_packet")) & (F.col("__b") >= F.col("end_packet")), 0).otherwise(1))
    best = m.groupBy("path", "pid", "issue_id").agg(F.min(F.struct("__rank", "item_id")).alias("x"))
    out = issues.join(best, ["path", "pid", "issue_id"], "left")
    return out.withColumns({"status": F.when(F.col("x.__rank") == 0, "Repaired").when(F.col("x.__rank") == 1, "PartlyRepaired").otherwise("Open"), "item_id": F.col("x.item_id")}).drop("x")


def linked(segments: DataFrame, events: DataFrame, reach: int = 16_384) -> DataFrame:
    """``affects_timestamps`` of timeline segments: whether a timestamp step of the same size (within 0.25 s or 10 %) stands within ``reach`` packets."""
    steps = events.where("type in ('PtsJump', 'PtsBackward', 'DtsBackward')").select("path", F.col("packet_index").alias("__at"), F.col("arg1").alias("__step"))
    size = F.abs("error") / 90_000
    near = seq.band_join(segments, steps, ["path"], "start_packet", "__at", reach).where(F.abs(F.abs("__step") - size) <= F.greatest(F.lit(0.25), size * 0.1))
    return segments.join(near.select("path", "pid", "start_packet").distinct().withColumn("__hit", F.lit(True)), ["path", "pid", "start_packet"], "left").withColumn("affects_timestamps", F.coalesce("__hit", F.lit(False))).drop("__hit")
