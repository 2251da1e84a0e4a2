"""Formatting, parsing and sort keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_pid(pid: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(pid.cast("long")), 4, "0"))


def clock_text(millis: Column, wrap_days: bool = False) -> Column:
    """HH:mm:ss.fff of milliseconds, with total hours or hours modulo 24."""
    hours = F.floor(millis / 3_600_000)
    part = lambda by, mod, n: F.lpad((F.floor(millis / by) % mod).cast("string"), n, "0")
    h = (hours % 24 if wrap_days else hours).cast("string")
    h = F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h)
    return F.concat(h, F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))


def _scaled(value: Column, step: int, units: list[str]) -> Column:
    out = None
    for i in reversed(range(len(units))):
        text = F.concat(F.format_string("%.2f", F.round(value / float(step**i), 2)), F.lit(" " + units[i]))
        out = text if out is None else F.when(value < step ** (i + 1), text).otherwise(out)
    return out


def size_text(n: Column) -> Column:
    return _scaled(n.cast("double"), 1024, ["B", "KB", "MB", "GB", "TB"])


def bitrate_text(bits_per_second: Column) -> Column:
    return _scaled(bits_per_second.cast("double"), 1000, ["bps", "Kbps", "Mbps", "Gbps"])


def parse_number(text: Column) -> Column:
    """Trimmed decimal or 0x-hexadecimal; null for anything else."""
    t = F.trim(text)
    return F.when(t.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10).cast("long")).when(t.rlike("^[+-]?[0-9]{1,18}$"), t.cast("long"))


def parse_time(text: Column) -> Column:
    """Seconds of ``h:m:s.f``; null for anything else."""
    shape = r"^(\d+):(\d+):(\d+\.\d+)$"
    part = lambda i: F.regexp_extract(text, shape, i).cast("double")
    return F.when(text.rlike(shape), part(1) * 3600 + part(2) * 60 + part(3))


def natural_key(name: Column) -> Column:
    """A sort key under which digit runs compare as numbers and letters without case; fewer leading zeros come first at ties.

    Digit runs are zero-padded to 20 places; longer ones keep their length."""
    low = F.lower(name)
    runs = F.regexp_extract_all(low, F.lit("([0-9]+|[^0-9]+)"), 1)
    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=[0-9])", ""), 20, "0")).otherwise(r))
    return F.struct(F.array_join(padded, "").alias("order"), F.length(name).alias("zeros"), name.alias("name"))


def mjd_to_date(mjd: Column) -> Column:
    """The date of a modified Julian day."""
    return F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))


def bcd(value: Column) -> Column:
    """A two-digit BCD byte as a number."""
    return F.shiftright(value, 4) * 10 + value.bitwiseAND(F.lit(15))


def nice_ceiling(value: Column) -> Column:
    """The smallest of 1, 2, 5 and 10 times a power of ten that is not below the value."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    ratio = value / power
    return F.when(value <= 0, F.lit(1.0)).otherwise(power * F.when(ratio <= 1, 1).when(ratio <= 2, 2).when(ratio <= 5, 5).otherwise(10))
