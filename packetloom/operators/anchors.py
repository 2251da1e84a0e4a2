"""Elementary-stream repair: byte anchors around a gap are looked up in a donor's bytes, and regions of PES units between equal units.

Byte anchors serve where packet hashes cannot match, as when a donor was multiplexed anew. A gap's search is one group of a grouped map:
its donor bytes are those within two seconds of its time, whatever the length of the streams.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import audio, synth
from packetloom.operators import seq

ANCHOR = 128
REACH = 2 * 90_000
MOST_PACKETS = 15
FOUND = "path string, pid int, gap_id long, donor_path string, start long, length long, payload binary"
#: kinds whose frames can be told apart, so a cut must fall on a frame's edge
FRAMED = ("MpegAudio", "AacAdts", "AacLatm")


def before_anchor(data: bytes) -> tuple[bytes, bytes] | None:
    """The last discriminating stretch of ``ANCHOR`` bytes, and what follows it (bytes to verify, not to rewrite)."""
    for end in range(len(data), ANCHOR - 1, -1):
        if audio.discriminating(data[end - ANCHOR : end]):
            return data[end - ANCHOR : end], data[end:]
    return None


def match(before: bytes, after: bytes, donor: bytes, missing: int, kind: str = "None") -> tuple[int, int] | None:
    """(start, length) of the bytes that a donor has between the two sides of a gap; null unless exactly one place fits.

    ``missing`` counts packets modulo 16; the bytes must be of a length that so many packets carry, and for framed audio whole frames."""
    anchor = before_anchor(before)
    head = after[:ANCHOR]
    if anchor is None or len(head) < ANCHOR:
        return None
    places = set()
    at = donor.find(anchor[0])
    while at >= 0:
        start = at + ANCHOR + len(anchor[1])
        if donor[at + ANCHOR : start] == anchor[1]:
            stop = donor.find(head, start)
            n = stop - start
            if stop >= 0 and 0 < n <= MOST_PACKETS * 184 and fits(n, missing):
                whole = before[-ANCHOR:] + donor[start:stop] + head
                if kind not in FRAMED or aligned(kind, whole):
                    places.add((start, n))
        at = donor.find(anchor[0], at + 1)
    return places.pop() if len(places) == 1 else None


def fits(n: int, missing: int) -> bool:
    """Whether ``n`` bytes can travel in a number of packets that is ``missing`` modulo 16 and at most ``MOST_PACKETS``."""
    return any(k <= n <= k * 184 for k in range(missing % 16 or 16, MOST_PACKETS + 1, 16))


def aligned(kind: str, data: bytes) -> bool:
    """Whether frames follow one another through the stretch without a hole."""
    found = audio.frames(kind, data)
    return len(found) > 1 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))


def search(gaps: DataFrame, donor: DataFrame) -> DataFrame:
    """Byte matches of gaps (path, pid, gap_id, t, before, after, missing, kind, donor_path, donor_pid) in donor payloads (donor_path, donor_pid, t, packet_index, payload).

    Donor payloads meet gaps by a band join on time."""
    near = seq.band_join(gaps.select("path", "pid", "gap_id", "donor_path", "donor_pid", F.col("t").alias("gt")), donor.withColumnRenamed("t", "dt"), ["donor_path", "donor_pid"], "gt", "dt", REACH)
    near = near.select("path", "pid", "gap_id", "donor_path", "packet_index", "payload")
    # the gap's own bytes travel once, on a row of their own
    own = gaps.select("path", "pid", "gap_id", "donor_path", F.lit(-1).cast("long").alias("packet_index"), F.lit(None).cast("binary").alias("payload"), "before", "after", "missing", "kind")
    rows = near.withColumns({"before": F.lit(None).cast("binary"), "after": F.lit(None).cast("binary"), "missing": F.lit(None).cast("int"), "kind": F.lit(None).cast("string")}).unionByName(own)

    def look(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("packet_index")
        head = f.iloc[0]
        names = [c.split()[0] for c in FOUND.split(", ")]
        if head.packet_index != -1:
            return pd.DataFrame([], columns=names)
        data = b"".join(bytes(x) for x in f.payload.iloc[1:])
        hit = match(bytes(head.before), bytes(head.after), data, int(head.missing), head.kind)
        return pd.DataFrame([(head.path, head.pid, head.gap_id, head.donor_path, hit[0], hit[1], data[hit[0] : hit[0] + hit[1]])] if hit else [], columns=names)

    return rows.groupBy("path", "pid", "gap_id", "donor_path").applyInPandas(look, FOUND)


def packetized(payload: bytes, pid: int, cc: int, missing: int, pusi_at: tuple[int, ...] = ()) -> list[bytes]:
    """Elementary bytes dealt to as many packets as the counters lack; ``pusi_at`` are offsets at which a PES header starts a packet."""
    n = next((k for k in range(missing % 16 or 16, MOST_PACKETS + 1, 16) if k <= len(payload) <= k * 184), None)
    edges = sorted({0, *pusi_at, len(payload)})
    parts = [payload[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    least = [-(-len(p) // 184) for p in parts]
    if n is None or sum(least) > n or n > len(payload):
        raise ValueError("the bytes do not fit the missing packets")
    # one more packet goes to the part with the most bytes per packet until all are dealt
    while sum(least) < n:
        i = max((i for i in range(len(parts)) if least[i] < len(parts[i])), key=lambda i: (len(parts[i]) / least[i], -i))
        least[i] += 1
    out = []
    for p, k, first in zip(parts, least, edges, strict=False):
        for j in range(k):
            a, b = len(p) * j // k, len(p) * (j + 1) // k
            out.append(synth.packet(pid, cc + len(out), p[a:b], pusi=j == 0 and first in pusi_at))
    return out


def region_candidates(reference: DataFrame, donor: DataFrame, damaged: DataFrame, longest: int = 4096) -> DataFrame:
    """Donor unit ranges for damaged unit ranges, from PES signatures.

    ``damaged``: (pid, region_id, before1, before2, after1, after2, duration), the signatures of two good units on each side and the ticks between;
    ``donor`` units: (path, pid, packet_index, pts, packets, signature). Durations agree within 0.1 s."""
    w = Window.partitionBy("path", "pid").orderBy("packet_index")
    pairs = donor.withColumns({"next_signature": F.lead("signature").over(w), "next_packet": F.lead("packet_index").over(w), "upto": F.sum("packets").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    side = lambda a, b, **names: pairs.select(F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), F.col("signature").alias(a), F.col("next_signature").alias(b), *[F.col(c).alias(n) for n, c in names.items()])
    start = damaged.join(side("before1", "before2", start_packet="next_packet", start_t="pts", start_sum="upto"), ["before1", "before2"])
    end = side("after1", "after2", end_packet="packet_index", end_t="pts", end_sum="upto")
    found = start.join(end, ["donor_path", "donor_pid", "after1", "after2"]).where("end_packet > start_packet")
    return found.where(f"abs(end_t - start_t - duration) <= 9000 and end_sum - start_sum <= {longest}").select("pid", "region_id", "donor_path", "donor_pid", "start_packet", "end_packet")


def identified(reference: DataFrame, donor: DataFrame, least: int = 3, enough: int = 16) -> DataFrame:
    """(pid, donor_path, donor_pid) of tracks that share sampled payload hashes: min(16, available) of them, 3 at least."""
    a, b = reference.select("pid", "h").distinct(), donor.select(F.col("path").alias("donor_path"), F.col("pid").alias("donor_pid"), "h").distinct()
    have = a.groupBy("pid").agg(F.count(F.lit(1)).alias("own"))
    hits = a.join(b, "h").groupBy("pid", "donor_path", "donor_pid").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(F.broadcast(have), "pid").where(F.col("hits") >= F.greatest(F.lit(least), F.least(F.lit(enough), F.col("own")))).select("pid", "donor_path", "donor_pid", "hits")


def broadcast_times(rows: DataFrame, times: DataFrame) -> DataFrame:
    """``utc_seconds`` of rows (path, packet_index, t): from the nearer of the clock announcements around them, moved by the difference of the clocks.

    ``times``: (path, packet_index, utc_seconds, t), one row every few seconds of stream."""
    mark = times.select("path", "packet_index", F.struct("utc_seconds", "t", "packet_index").alias("m"))
    flip = lambda df: df.withColumn("__back", -F.col("packet_index"))
    left = seq.asof(rows, mark, ["path"], "packet_index", "m", "__left")
    both = seq.asof(flip(left), flip(mark).drop("packet_index"), ["path"], "__back", "m", "__right").drop("__back")
    near = F.when(F.col("__left").isNull(), F.col("__right")).when(F.col("__right").isNull(), F.col("__left")).when(
        F.col("packet_index") - F.col("__left.packet_index") <= F.col("__right.packet_index") - F.col("packet_index"), F.col("__left")).otherwise(F.col("__right"))
    return both.withColumn("__m", near).withColumn("utc_seconds", F.col("__m.utc_seconds") + (F.col("t") - F.col("__m.t")) / 90_000.0).drop("__left", "__right", "__m")
