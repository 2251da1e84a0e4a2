"""Transport-packet decoding as Column expressions: header, adaptation field, clocks and PES timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 188
NULL_PID = 0x1FFF
#: PES stream ids without the optional header: fixed values.
PLAIN_STREAM_IDS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
#: PIDs of service information: fixed values.
SI_PIDS = (0x10, 0x11, 0x12, 0x13, 0x14, 0x1FFB)


def number(raw: Column, at: Column | int, n: int) -> Column:
    """``n`` (at most 7) bytes from offset ``at`` as a big-endian integer; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(raw, at + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def header_fields(header: Column) -> dict[str, Column]:
    """Fields of a header word, by name."""
    bits = lambda shift, mask: F.shiftright(header, shift).bitwiseAND(F.lit(mask))
    return {
        "sync": bits(24, 0xFF).cast("int"), "tei": bits(23, 1) == 1, "pusi": bits(22, 1) == 1, "priority": bits(21, 1) == 1, "pid": bits(8, 0x1FFF).cast("int"),
        "scrambling": bits(6, 3).cast("int"), "afc": bits(4, 3).cast("int"), "cc": bits(0, 15).cast("int"),
    }


def timestamp33(v: Column) -> Column:
    """The 33 bits of a PES timestamp in its five bytes (3 + 15 + 15, markers between)."""
    part = lambda shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask))
    return F.shiftleft(part(33, 7), 30) + F.shiftleft(part(17, 0x7FFF), 15) + part(1, 0x7FFF)


def decode(packets: DataFrame, keep_raw: bool = True) -> DataFrame:
    """Adds the decoded columns to rows that have ``raw``; an unparsable packet keeps what its header says and a ``parse_error``."""
    raw = F.col("raw")
    df = packets.withColumn("header", number(raw, 0, 4)).select("*", *[c.alias(n) for n, c in header_fields(F.col("header")).items()])
    field = F.col("afc").bitwiseAND(F.lit(2)) != 0
    df = df.withColumn("af_len", F.when(field, number(raw, 4, 1)).cast("int"))
    error = (
        F.when(F.octet_length(raw) != SIZE, "InvalidSize").when(F.col("sync") != 0x47, "InvalidSyncByte").when(F.col("afc") == 0, "ReservedAdaptationControl")
        .when(F.col("af_len") > 183, "InvalidAdaptationLength")
    )
    df = df.withColumn("parse_error", error)
    sound = F.col("parse_error").isNull()
    df = df.withColumn("af_flags", F.when(sound & (F.col("af_len") > 0), number(raw, 5, 1)).cast("int"))
    flag = lambda bit: F.coalesce(F.col("af_flags").bitwiseAND(F.lit(bit)) != 0, F.lit(False))
    df = df.withColumn("payload_offset", F.when(~sound, SIZE).when(field, 5 + F.col("af_len")).otherwise(4))
    has_pcr = flag(0x10) & (F.col("af_len") >= 7)
    df = df.withColumns({
        "has_payload": sound & (F.col("afc").bitwiseAND(F.lit(1)) != 0) & (F.col("payload_offset") < SIZE), "discontinuity": flag(0x80), "random_access": flag(0x40),
        "es_priority": flag(0x20), "has_opcr": flag(0x08) & (F.col("af_len") >= F.when(has_pcr, 13).otherwise(7)), "splice": flag(0x04), "private_data": flag(0x02), "extension": flag(0x01),
        "__pcr": F.when(has_pcr, number(raw, 6, 6)),
    })
    at = F.col("payload_offset")
    starts = F.col("pusi") & F.col("has_payload") & (at + 14 <= SIZE)
    df = df.withColumn("__pes", F.when(starts & (number(raw, at, 3) == 1), number(raw, at + 7, 1)))
    # a header that runs on into the next packet is read by detect.late_stamps
    whole = at + 9 + number(raw, at + 8, 1) <= SIZE
    stamps = F.when(whole, F.shiftright("__pes", 6))
    df = df.withColumns({
        "pcr_base": F.shiftright("__pcr", 15), "pcr_ext": F.col("__pcr").bitwiseAND(F.lit(0x1FF)).cast("int"),
        "stream_id": F.when(F.col("__pes").isNotNull(), number(raw, at + 3, 1)).cast("int"),
        "pts": F.when(stamps >= 2, timestamp33(number(raw, at + 9, 5))), "dts": F.when((stamps == 3) & (at + 19 <= SIZE), timestamp33(number(raw, at + 14, 5))),
    })
    return df.drop("__pcr", "__pes", "sync", *([] if keep_raw else ["raw"]))


def timestamp_text() -> Column:
    """``PCR .. / PTS .. / DTS ..`` of a decoded row, what is there."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name + " "), F.col(c).cast("string")))
    return F.concat_ws(" / ", part("PCR", "pcr_base"), part("PTS", "pts"), part("DTS", "dts"))
