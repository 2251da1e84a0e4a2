"""Ordered-sequence operators over any DataFrame: the cores of the transport-stream detectors.

:func:`scan` is the one primitive: lags, running sums and last values per key. Scans over the same keys share one exchange, so a detector of
several steps shuffles its packets once. Where one key holds most of the rows (one PID of a stream often does) or there is no key at
all, the sequence is split into chunks of its integer order instead: windows run inside chunks, and a table with one row per chunk carries values
over the borders, so no task sorts a whole key. The setting ``packetloom.scan.chunk`` (rows per chunk) turns this on for keyed scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
SETTING = "packetloom.scan.chunk"


def scan(
    df: DataFrame, keys: Sequence[str], order: str, lags: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, chunk: int | None = None,
) -> DataFrame:
    """Adds, per key in order: ``lags`` (value of the row before), ``sums`` (running, this row included), ``lasts`` (last value that is
    not null, this row included) and ``before`` (the same without this row). ``order`` is an integer, unique within a key."""
    lags, sums, lasts, before = lags or {}, sums or {}, lasts or {}, before or {}
    chunk = chunk or int(df.sparkSession.conf.get(SETTING, "0")) or (0 if keys else CHUNK)
    if not chunk:
        w = Window.partitionBy(*keys).orderBy(order)
        upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*", *[F.lag(c).over(w).alias(n) for n, c in lags.items()], *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in lasts.items()], *[F.last(c, ignorenulls=True).over(prior).alias(n) for n, c in before.items()])
    keys = list(keys)
    base = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    w = Window.partitionBy(*keys, "__chunk").orderBy(order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    box = lambda c: F.struct(c.alias("v"))  # noqa: E731  tells a null value from no row
    local, ends, carry, final = {}, {}, {}, {}
    over = Window.partitionBy(*keys).orderBy("__chunk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    for n, c in lags.items():
        local[n] = F.lag(box(c)).over(w)
        ends[f"__{n}"] = F.max_by(box(c), F.col(order))
        carry[f"__{n}"] = F.lag(f"__{n}").over(over)
        final[n] = F.coalesce(F.col(n), F.col(f"__{n}"))["v"]
    for n, c in sums.items():
        local[n] = F.sum(c).over(upto)
        ends[f"__{n}"] = F.sum(c)
        carry[f"__{n}"] = F.sum(f"__{n}").over(earlier)
        final[n] = F.coalesce(F.col(n) + F.col(f"__{n}"), F.col(n), F.col(f"__{n}"))
    for n, c in [*lasts.items(), *before.items()]:
        local[n] = F.last(c, ignorenulls=True).over(upto if n in lasts else prior)
        ends[f"__{n}"] = F.max_by(c, F.when(c.isNotNull(), F.col(order)))
        carry[f"__{n}"] = F.last(f"__{n}", ignorenulls=True).over(earlier)
        final[n] = F.coalesce(F.col(n), F.col(f"__{n}"))
    at = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    borders = base.groupBy(*keys, "__chunk").agg(*[c.alias(n) for n, c in ends.items()]).withColumns(carry)
    borders = borders.select(*at, F.col("__chunk").alias("__border"), *ends)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__chunk") == F.col("__border"))
    joined = base.withColumns(local).join(borders, same)
    return joined.withColumns(final).select(*df.columns, *local)


def unwrap(df: DataFrame, keys: Sequence[str], order: str, raw: str, bits: int = 33, out: str = "unwrapped", empty: bool = False) -> DataFrame:
    """Clock values of ``bits`` bits made continuous: only jumps of more than half the range are wraps. Rows without a value are dropped, or stay if ``empty``."""
    span, half = 1 << bits, 1 << (bits - 1)
    rows = scan(df, keys, order, before={"__was": F.col(raw)}) if empty else scan(df.where(F.col(raw).isNotNull()), keys, order, lags={"__was": F.col(raw)})
    turn = F.when(F.col("__was") - F.col(raw) > half, span).when(F.col(raw) - F.col("__was") > half, -span).otherwise(0).cast("long")
    rows = scan(rows.withColumn("__turn", turn), keys, order, sums={"__turns": F.col("__turn")})
    return rows.withColumn(out, F.col(raw) + F.col("__turns")).drop("__was", "__turn", "__turns")


def segments(df: DataFrame, keys: Sequence[str], order: str, reset: Column, out: str = "segment") -> DataFrame:
    """Numbers the stretches between resets; a row that resets opens its own stretch."""
    return scan(df, keys, order, sums={out: reset.cast("long")})


def sessions(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, values: Sequence[str] = ()) -> DataFrame:
    """Coalesces intervals of one key whose start is at most ``gap`` after the end before: first start, last end, count, first values."""
    rows = scan(df, keys, start, before={"__end": F.col(end)})
    rows = scan(rows, keys, start, sums={"__session": (F.col("__end").isNull() | (F.col(start) - F.col("__end") > gap)).cast("long")})
    first = [F.min_by(v, start).alias(v) for v in values]
    return rows.groupBy(*keys, "__session").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("occurrences"), *first).drop("__session")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions intervals [start, end] that overlap or touch. A key's intervals meet in one task: lists of edits, not of packets."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("long"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def upper_median(values: Column) -> Column:
    """The upper of the two middle elements of an array, without interpolation; nulls are left out."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def rolling_upper_median(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, out: str, at_least: int = 1) -> DataFrame:
    """Upper median of the last ``rows`` values before this row; null if there are fewer than ``at_least``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    frame = F.collect_list(value).over(w)
    return df.withColumn(out, F.when(F.size(frame) >= at_least, upper_median(frame)))


def asof(df: DataFrame, other: DataFrame, keys: Sequence[str], order: str, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """For each row the value of ``other`` with the greatest order up to (or before) its own, by one pass over both."""
    mark = 0 if inclusive else 1
    both = df.select(*keys, F.col(order), F.struct(*df.columns).alias("__row"), F.lit(None).cast(dict(other.dtypes)[value]).alias("__v"), F.lit(1 - mark).alias("__side")).unionByName(
        other.select(*keys, F.col(order), F.lit(None).alias("__row"), F.col(value).alias("__v"), F.lit(mark).alias("__side")))
    both = scan(both.withColumn("__o", F.col(order) * 2 + F.col("__side")), keys, "__o", lasts={out: F.col("__v")})
    return both.where("__row is not null").select("__row.*", out)


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, reach: int) -> DataFrame:
    """Pairs of equal ``on`` with |a - b| <= reach, as an equi-join on cells of that width: a left row meets three cells."""
    cell = lambda c: F.floor(F.col(c) / F.lit(reach))
    spread = left.withColumn("__cell", F.explode(F.array(cell(a) - 1, cell(a), cell(a) + 1)))
    return spread.join(right.withColumn("__cell", cell(b)), [*on, "__cell"]).where(F.abs(F.col(a) - F.col(b)) <= reach).drop("__cell")


def best(df: DataFrame, keys: Sequence[str], by: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """The row of each key that comes first by ``by``; an aggregate, so that a hot key is reduced before the exchange."""
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("__best")).select(*keys, "__best.*")


def ngram_matches(left: DataFrame, right: DataFrame, n: int, order: str, token: str) -> DataFrame:
    """Pairs of positions (start_a, start_b) at which two sequences agree on ``n`` tokens. One sequence a table."""
    def grams(df: DataFrame, out: str) -> DataFrame:
        # positions whose n-gram crosses a chunk border are completed from the next chunk's first rows
        lap = df.where(F.col(order) % CHUNK < n - 1).select((F.floor(F.col(order) / CHUNK) - 1).alias("__c"), order, token)
        rows = df.select(F.floor(F.col(order) / CHUNK).alias("__c"), order, token).unionByName(lap)
        w = Window.partitionBy("__c").orderBy(order)
        parts = [F.lead(token, k).over(w) for k in range(n)]
        rows = rows.select("__c", F.col(order).alias(out), F.lead(order, n - 1).over(w).alias("__end"), F.xxhash64(*parts).alias("__gram"))
        return rows.where((F.col("__end") == F.col(out) + n - 1) & (F.floor(F.col(out) / CHUNK) == F.col("__c"))).select(out, "__gram")

    return grams(left, "start_a").join(grams(right, "start_b"), "__gram").drop("__gram")
