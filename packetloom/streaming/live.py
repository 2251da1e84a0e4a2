"""Streaming forms of the detectors: keyed counter state, bitrate buckets as tumbling windows, sessions of events.

Packets of one PID must come in order: within a micro-batch they are sorted, and late ones (below the last index seen) are counted, not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAULTS = "path string, pid int, packet_index long, fault string, missing int"
STATE = "packet_index long, cc int, body long, late long"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    index, cc, body, late = state.get if state.exists else (-1, -1, 0, 0)
    out = []
    rows = pd.concat(list(frames)).sort_values("packet_index")
    for r in rows.itertuples():
        if r.packet_index <= index:
            late += 1
            continue
        index = r.packet_index
        if r.tei or r.discontinuity:
            cc = -1
        if r.tei or not r.has_payload:
            continue
        if cc == r.cc:
            out.append((*key, index, "Duplicate" if r.body == body else "ConflictingDuplicate", 0))
            continue
        if cc >= 0 and (gap := (r.cc - cc - 1) & 15):
            out.append((*key, index, "Gap", gap))
        cc, body = r.cc, r.body
    state.update((int(index), int(cc), int(body), int(late)))
    yield pd.DataFrame(out, columns=["path", "pid", "packet_index", "fault", "missing"])


def continuity(packets: DataFrame) -> DataFrame:
    """Counter faults of a stream of decoded packets; the state of a PID is four numbers."""
    rows = packets.select("path", "pid", "packet_index", "cc", "tei", "discontinuity", F.col("has_payload") & F.col("parse_error").isNull(), F.xxhash64(F.substring("raw", 5, 184)).alias("body"))
    rows = rows.toDF("path", "pid", "packet_index", "cc", "tei", "discontinuity", "has_payload", "body")
    return rows.groupBy("path", "pid").applyInPandasWithState(_follow, FAULTS, STATE, "append", GroupStateTimeout.NoTimeout)


def bitrate_buckets(events: DataFrame, time: str, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Rows per bucket and key; a bucket closes when the watermark passes it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("packets")).select(F.col("w.start").alias("start"), key, "packets")


def event_sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 seconds") -> DataFrame:
    """Events of one key that follow within ``gap`` become one session."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("occurrences"))
    return s.select(F.col("w.start").alias("start"), *keys, "occurrences")
