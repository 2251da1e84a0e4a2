"""Looking around in packets: windows, the next packet of a PID, and runs of damage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import audio, packet
from packetloom.operators import seq


def window(p: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` packets from ``start`` on; the bounds reach the split planner."""
    return p.where(F.col("packet_index").between(start, start + count - 1)).orderBy("packet_index")


def same_pid(p: DataFrame, index: int, pid: int, forward: bool = True) -> int | None:
    """The nearest packet of a PID after (or before) a place, among those that parse: a minimum, not a sort."""
    rows = p.where((F.col("pid") == pid) & F.col("parse_error").isNull() & (F.col("packet_index") > index if forward else F.col("packet_index") < index))
    return rows.agg((F.min if forward else F.max)("packet_index")).first()[0]


def si_continuity(p: DataFrame) -> DataFrame:
    """Counter errors of the service-information PIDs per (path, pid); duplicates are free, damage and discontinuities start anew."""
    rows = p.where(F.col("pid").isin(list(packet.SI_PIDS)) & (F.col("has_payload") | F.col("tei") | F.col("discontinuity")))
    rows = seq.scan(rows, ["path", "pid"], "packet_index", sums={"__cut": (F.col("tei") | F.col("discontinuity")).cast("long")})
    rows = seq.scan(rows.where("has_payload and not tei"), ["path", "pid", "__cut"], "packet_index", lags={"__was": F.col("cc")})
    off = F.pmod(F.col("cc") - F.col("__was"), F.lit(16))
    return rows.groupBy("path", "pid").agg(F.sum(F.coalesce((off > 1), F.lit(False)).cast("long")).alias("errors"))


def damage_runs(p: DataFrame, least: int = 16) -> DataFrame:
    """Runs of damaged payload packets of a PID as gaps: the counters before and after tell how many packets lack; runs of a multiple of 16 count if they are long."""
    keys = ["path", "pid"]
    rows = p.where("tei or (has_payload and parse_error is null)")
    rows = seq.scan(rows, keys, "packet_index", sums={"__sound": (~F.col("tei")).cast("long")}, before={"last_cc": F.when(~F.col("tei"), F.col("cc"))})
    runs = rows.where("tei").groupBy(*keys, "__sound").agg(F.min("packet_index").alias("start_packet"), F.max("packet_index").alias("end_packet"), F.count(F.lit(1)).alias("damaged"), F.first("last_cc").alias("last_cc"))
    nxt = rows.where("not tei").select(*keys, (F.col("__sound") - 1).alias("__sound"), F.col("cc").alias("next_cc"))
    out = runs.join(nxt, [*keys, "__sound"]).withColumn("missing", F.pmod(F.col("next_cc") - F.col("last_cc") - 1, F.lit(16)))
    return out.where(f"last_cc is not null and (missing > 0 or damaged >= {least})").drop("__sound")


def audio_layers(es: DataFrame, limit: int = 65_536) -> DataFrame:
    """(path, pid, layer) from the first valid frame header in the first 64 KiB of each elementary stream."""
    rows = seq.scan(es, ["path", "pid"], "packet_index", sums={"__upto": F.octet_length("payload").cast("long")})
    head = rows.where(F.col("__upto") - F.octet_length("payload") < limit)

    def probe(f: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(bytes(x) for x in f.sort_values("packet_index").payload)
        return pd.DataFrame({"path": f.path[:1], "pid": f.pid[:1], "layer": [audio.probe_layer(data, limit)]})

    return head.select("path", "pid", "packet_index", "payload").groupBy("path", "pid").applyInPandas(probe, "path string, pid int, layer string")
