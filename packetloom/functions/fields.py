"""The field tree of a packet, flat: path, kind, value, bytes and bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import PLAIN_STREAM_IDS

SCHEMA = "array<struct<path:string,kind:string,value:string,start_byte:int,byte_length:int,high_bit:int,low_bit:int>>"
_HEADER = (("sync_byte", 0, 31, 24), ("transport_error", 1, 23, 23), ("payload_start", 1, 22, 22), ("priority", 1, 21, 21), ("pid", 1, 20, 8), ("scrambling", 3, 7, 6), ("adaptation_control", 3, 5, 4), ("continuity_counter", 3, 3, 0))
_FLAGS = ("discontinuity", "random_access", "es_priority", "pcr", "opcr", "splicing_point", "private_data", "extension")


def tree(raw: bytes | None) -> list[tuple]:
    """Fields in order of place; nothing for what is not a packet."""
    if raw is None or len(raw) != 188:
        return []
    word = int.from_bytes(raw[:4], "big")
    out = [(f"header/{n}", "bits", str(word >> low & (1 << high - low + 1) - 1), at, 2 if n == "pid" else 1, high, low) for n, at, high, low in _HEADER]
    afc, at = word >> 4 & 3, 4
    if afc & 2:
        n = raw[4]
        out.append(("adaptation/length", "byte", str(n), 4, 1, 7, 0))
        at = 5 + n
        if n > 183:
            return out
        if n:
            out += [(f"adaptation/{f}", "bit", str(raw[5] >> 7 - i & 1), 5, 1, 7 - i, 7 - i) for i, f in enumerate(_FLAGS)]
            if raw[5] & 0x10 and n >= 7:
                v = int.from_bytes(raw[6:12], "big")
                out += [("adaptation/pcr_base", "bits", str(v >> 15), 6, 5, 47, 15), ("adaptation/pcr_extension", "bits", str(v & 0x1FF), 10, 2, 8, 0)]
    if not afc & 1 or at >= 188:
        return out
    out.append(("payload", "bytes", str(188 - at), at, 188 - at, 7, 0))
    if not word >> 22 & 1:
        return out
    p = raw[at:]
    if p[:3] == b"\0\0\1" and len(p) >= 6:
        out += [("payload/pes/stream_id", "byte", f"0x{p[3]:02X}", at + 3, 1, 7, 0), ("payload/pes/length", "word", str(p[4] << 8 | p[5]), at + 4, 2, 15, 0)]
        if p[3] not in PLAIN_STREAM_IDS and len(p) >= 9:
            out += [("payload/pes/pts_dts_flags", "bits", str(p[7] >> 6), at + 7, 1, 7, 6), ("payload/pes/header_length", "byte", str(p[8]), at + 8, 1, 7, 0)]
    elif at + 1 + p[0] + 3 <= 188:
        s = at + 1 + p[0]
        out += [("payload/psi/pointer", "byte", str(p[0]), at, 1, 7, 0), ("payload/psi/table_id", "byte", f"0x{raw[s]:02X}", s, 1, 7, 0), ("payload/psi/section_length", "bits", str((raw[s + 1] & 15) << 8 | raw[s + 2]), s + 1, 2, 11, 0)]
    return out


def with_tree(packets: DataFrame, column: str = "fields") -> DataFrame:
    """``packets`` with the field tree of ``raw``; meant for a window of packets, as an inspector shows."""
    names = ("path", "kind", "value", "start_byte", "byte_length", "high_bit", "low_bit")

    def run(raw):
        return raw.map(lambda r: [dict(zip(names, x, strict=True)) for x in tree(None if r is None else bytes(r))])

    run.__annotations__ = {"raw": pd.Series, "return": pd.Series}
    return packets.withColumn(column, F.pandas_udf(run, SCHEMA)("raw"))
