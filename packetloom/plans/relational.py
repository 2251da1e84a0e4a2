"""The operators' relational cores over the driver's tables, each with SQL in :mod:`packetloom.plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import packet, text
from packetloom.operators import seq
from packetloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def events(spark: SparkSession, d: str) -> DataFrame:
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return read_table(spark, d, "events").select("event_id", us.alias("us"), "user_id", "event_type", "value")


def packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets encoded from events: a header word with all its fields, and a clock."""
    e = events(spark, d).select("event_id", (256 + F.pmod("user_id", F.lit(8))).cast("int").alias("pid"), "event_type", "value")
    step = F.when(F.col("event_id") % 97 == 0, 2).otherwise(1)
    e = seq.scan(e, ["pid"], "event_id", sums={"n": step.cast("long")})
    is_ = lambda t: (F.col("event_type") == t).cast("long")
    afc = F.when(F.col("event_type") == "purchase", 3).otherwise(1).cast("long")
    cc = F.pmod(F.col("n"), F.lit(16))
    word = F.lit(71 << 24).cast("long") + F.shiftleft(is_("error"), 23) + F.shiftleft(is_("signup"), 22) + F.shiftleft(F.col("pid").cast("long"), 8) + F.shiftleft(afc, 4) + cc
    clock = F.pmod(F.col("event_id") * 3000, F.lit(1 << 33))
    return e.select("event_id", word.alias("header"), clock.alias("pcr_base"), F.xxhash64("event_id").alias("body"))


def decoded(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d)
    return p.select("event_id", "header", "pcr_base", *[c.alias(n) for n, c in packet.header_fields(F.col("header")).items()])


@query
def header_decode(spark, d):
    return decoded(spark, d).drop("pcr_base")


@query
def pid_summary(spark, d):
    """Packets, payload packets, transport errors, duplicates and continuity gaps per PID."""
    p = continuity(spark, d)
    n = lambda c: F.sum(c.cast("long"))
    return p.groupBy("pid").agg(
        F.count(F.lit(1)).alias("packets"), n(~F.col("tei")).alias("payload_packets"), n(F.col("tei")).alias("transport_errors"),
        n(~F.col("tei") & (F.col("scrambling") >= 2)).alias("scrambled"), n(F.coalesce(F.col("last_cc") == F.col("cc"), F.lit(False))).alias("duplicates"), n(F.col("missing") > 0).alias("gaps"))


def continuity(spark, d) -> DataFrame:
    """Each packet with the counter of its predecessor in its stretch; transport errors cut stretches and take no part."""
    p = seq.scan(decoded(spark, d), ["pid"], "event_id", sums={"stretch": F.col("tei").cast("long")})
    q = seq.scan(p.where("not tei"), ["pid", "stretch"], "event_id", lags={"last_cc": F.col("cc")}).unionByName(p.where("tei").withColumn("last_cc", F.lit(None).cast("int")))
    off = F.pmod(F.col("cc") - F.col("last_cc") - 1, F.lit(16))
    return q.withColumn("missing", F.when(F.col("last_cc").isNull() | (F.col("cc") == F.col("last_cc")), 0).otherwise(off).cast("int"))


@query
def pid_share(spark, d):
    n = decoded(spark, d).groupBy("pid").agg(F.count(F.lit(1)).alias("packets"))
    total = n.agg(F.sum("packets").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("pid", "packets", F.round(F.col("packets") * 100.0 / F.col("total"), 6).alias("share"))


@query
def verdict(spark, d):
    n = decoded(spark, d).groupBy("pid").agg(F.sum(F.col("tei").cast("long")).alias("errors"), F.sum(F.col("pusi").cast("long")).alias("warnings"), F.count(F.lit(1)).alias("packets"))
    word = F.when(F.col("packets") < 10, "Incomplete").when(F.col("errors") > 0, "Error").when(F.col("warnings") > 0, "Warning").otherwise("Pass")
    return n.select("pid", word.alias("verdict"), "errors", "warnings")


@query
def error_totals(spark, d):
    """Counts per PID and over all, by grouping sets."""
    p = decoded(spark, d).where("tei or pusi")
    g = p.groupingSets([["pid"], []], "pid").agg(F.sum(F.col("tei").cast("long")).alias("errors"), F.sum(F.col("pusi").cast("long")).alias("warnings"))
    return g.select(F.coalesce("pid", F.lit(-1)).alias("pid"), "errors", "warnings")


@query
def continuity_gaps(spark, d):
    p = continuity(spark, d).where("missing > 0")
    return p.select("event_id", "pid", F.pmod(F.col("last_cc") + 1, F.lit(16)).cast("int").alias("expected"), "cc", "missing")


@query
def duplicate_runs(spark, d):
    """Runs of equal types in a user's events: the repeats of a run against its first row."""
    e = seq.scan(events(spark, d), ["user_id"], "event_id", lags={"was": F.col("event_type")})
    e = seq.scan(e, ["user_id"], "event_id", sums={"run": (F.col("was").isNull() | (F.col("was") != F.col("event_type"))).cast("long")})
    return e.groupBy("user_id", "run").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("run")


@query
def unwrap_clock(spark, d):
    e = events(spark, d).select("event_id", "user_id", F.pmod(F.col("event_id") * 4_000_037, F.lit(1 << 33)).alias("raw"))
    return seq.unwrap(e, ["user_id"], "event_id", "raw").select("event_id", "user_id", "unwrapped")


@query
def clock_checks(spark, d):
    """Steps of a user's clock that go back, jump or leave a gap."""
    e = seq.scan(events(spark, d), ["user_id"], "event_id", lags={"was": F.col("us")}).withColumn("delta", F.col("us") - F.col("was"))
    kind = F.when(F.col("delta") < -1000, "Backward").when(F.col("delta") > 6 * 3_600_000_000, "Jump").when(F.col("delta") > 3_600_000_000, "Gap")
    return e.select("event_id", "user_id", "delta", kind.alias("kind")).where("kind is not null")


@query
def reset_segments(spark, d):
    e = seq.segments(events(spark, d), ["user_id"], "event_id", F.col("event_type") == "error")
    return e.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def pes_units(spark, d):
    """Units between starts; those with a successor and without a kill are settled."""
    p = seq.scan(decoded(spark, d), ["pid"], "event_id", sums={"unit": F.when(F.col("tei"), 0).otherwise(F.col("pusi").cast("long"))})
    last = p.groupBy("pid").agg(F.max("unit").alias("last_unit"))
    u = p.where("unit > 0").groupBy("pid", "unit").agg(F.sum((~F.col("tei")).cast("long")).alias("n"), F.max(F.col("tei").cast("int")).alias("killed"), F.min("event_id").alias("start_id"))
    return u.join(F.broadcast(last), "pid").where("unit < last_unit and killed = 0").select("pid", "start_id", "n")


@query
def coalesce_events(spark, d):
    e = events(spark, d).where("event_type in ('error', 'signup')").select((F.pmod("user_id", F.lit(8))).alias("pid"), "event_type", F.col("event_id").alias("start_id"), F.col("event_id").alias("end_id"), "user_id")
    return seq.sessions(e, ["pid", "event_type"], "start_id", "end_id", 64, ["user_id"])


@query
def event_cap(spark, d):
    """The first 500 errors in order, and how many are left out: a top-k, reduced in each task before the exchange."""
    e = events(spark, d).where("event_type = 'error'").select("event_id", "user_id")
    total = e.agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy("event_id").limit(500).crossJoin(F.broadcast(total)).select("event_id", "user_id", F.greatest(F.lit(0), F.col("n") - 500).cast("long").alias("omitted"))


@query
def bitrate_longest_segment(spark, d):
    """Rate of the longest clean clock stretch of each PID."""
    p = seq.scan(decoded(spark, d), ["pid"], "event_id", lags={"was": F.col("pcr_base"), "at": F.col("event_id")})
    step = F.col("pcr_base") - F.col("was")
    bad = F.col("was").isNull() | (step <= 0) | (step > 90_000) | F.col("tei")
    p = seq.scan(p.withColumn("bad", bad), ["pid"], "event_id", sums={"stretch": F.col("bad").cast("long")})
    s = p.groupBy("pid", "stretch").agg((F.max("pcr_base") - F.min("pcr_base")).alias("ticks"), (F.count(F.lit(1)) - 1).alias("n"), F.min("event_id").alias("start_id")).where("ticks >= 45000")
    b = seq.best(s, ["pid"], [-F.col("ticks"), F.col("start_id")], ["ticks", "n", "start_id"])
    return b.select("pid", "ticks", "n", "start_id", F.round(F.col("n") * 188 * 8 * 90000.0 / F.col("ticks"), 3).alias("bitrate"))


def _intervals(spark, d) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", F.col("us"))
    e = seq.scan(e, ["user_id"], "event_id", lags={"was": F.col("us")})
    return e.where("was is not null and us > was and us - was <= 36000000000").select("user_id", F.col("was").alias("a"), F.col("us").alias("b"), F.lit(3600).cast("long").alias("n"))


def _buckets(spark, d, width: int = 3_600_000_000) -> DataFrame:
    """Counts of clock intervals spread over buckets in proportion to the overlap, in integers."""
    i = _intervals(spark, d).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    lap = F.least(F.col("b"), (F.col("bucket") + 1) * width) - F.greatest(F.col("a"), F.col("bucket") * width)
    return i.groupBy("bucket").agg(F.sum(F.floor(F.col("n") * lap / (F.col("b") - F.col("a")))).alias("packets"))


@query
def timeline_buckets(spark, d):
    return _buckets(spark, d).select("bucket", "packets")


@query
def timeline_compaction(spark, d):
    """Buckets merged pairwise until at most 64 are left: one re-bucketing by the power of two that takes."""
    b = _buckets(spark, d)
    span = b.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).select("low", F.greatest(F.lit(0), F.ceil(F.log2((F.col("high") - F.col("low") + 1) / 64.0))).cast("int").alias("power"))
    b = b.crossJoin(F.broadcast(span)).select(F.floor((F.col("bucket") - F.col("low")) / F.pow(F.lit(2.0), F.col("power"))).alias("slot"), "packets")
    return b.groupBy("slot").agg(F.sum("packets").alias("packets"))


@query
def asof_clock(spark, d):
    """Each error with the last clock seen before it: its user's, else its PID's."""
    e = events(spark, d).withColumn("pid", F.pmod("user_id", F.lit(8)))
    clock = F.when(F.col("event_type") == "view", F.col("us"))
    e = seq.scan(e, ["user_id"], "event_id", lasts={"own": clock})
    e = seq.scan(e, ["pid"], "event_id", lasts={"any": clock})
    return e.where("event_type = 'error'").select("event_id", "user_id", F.coalesce("own", "any").alias("clock"), F.col("own").isNull().alias("is_estimated"))


@query
def nearest_anchor(spark, d):
    """The purchase of the same user that is nearest by event id; ties to the earlier."""
    e = events(spark, d).select("event_id", "user_id", "event_type")
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    e = seq.scan(e, ["user_id"], "event_id", lasts={"left": mark})
    e = seq.scan(e.withColumn("back", -F.col("event_id")), ["user_id"], "back", lasts={"right": mark})
    near = F.when(F.col("right").isNull() | (F.col("event_id") - F.col("left") <= F.col("right") - F.col("event_id")), F.coalesce("left", "right")).otherwise(F.col("right"))
    return e.where("event_type = 'error'").select("event_id", near.alias("anchor"))


@query
def catalog_effective_join(spark, d):
    """Each event with the status of its user's latest order before it: an as-of dimension."""
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("priority"))
    o = o.groupBy("user_id", "event_id").agg(F.max("priority").alias("priority"))
    e = events(spark, d).where("event_type = 'click'").select("event_id", "user_id")
    return seq.asof(e, o, ["user_id"], "event_id", "priority", "effective", inclusive=False).select("event_id", "user_id", "effective")


@query
def track_mapping(spark, d):
    """Suppliers matched to customers of the same nation: ranked by balance distance, with the counts of both sides."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), (F.round(F.col("s_acctbal") * 100)).cast("long").alias("sb"))
    c = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_nationkey").alias("n"), (F.round(F.col("c_acctbal") * 100)).cast("long").alias("cb"))
    m = s.join(c, "n").where(F.abs(F.col("sb") - F.col("cb")) <= 50_000).withColumn("distance", F.abs(F.col("sb") - F.col("cb")))
    best = seq.best(m, ["s_suppkey"], [F.col("distance"), F.col("c_custkey")], ["c_custkey", "distance"])
    count = m.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("candidates"))
    back = best.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("claims"))
    return best.join(count, "s_suppkey").join(back, "c_custkey").select("s_suppkey", "c_custkey", "distance", "candidates", (F.col("claims") > 1).alias("ambiguous"))


@query
def offset_cluster_median(spark, d):
    """Date offsets of a part's line items from their orders: the biggest cluster of rounded offsets and its upper median."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("od"))
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("sd"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("l_suppkey", F.datediff("sd", "od").alias("off"))
    g = j.withColumn("cluster", F.bround(F.col("off") / 30.0, 0).cast("long")).groupBy("l_suppkey", "cluster").agg(F.count(F.lit(1)).alias("n"), F.collect_list("off").alias("offs"))
    b = seq.best(g.where("n >= 3"), ["l_suppkey"], [-F.col("n"), F.col("cluster")], ["cluster", "n", "offs"])
    return b.select("l_suppkey", "cluster", "n", seq.upper_median(F.col("offs")).cast("long").alias("offset"))


@query
def rolling_median31(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return seq.rolling_upper_median(o, ["o_custkey"], "o_orderkey", "cents", 31, "median", 5).where("median is not null").select("o_orderkey", "median")


@query
def large_gap(spark, d):
    """Steps above four times the median of the user's last 31 steps."""
    e = seq.scan(events(spark, d), ["user_id"], "event_id", lags={"was": F.col("us")}).where("was is not null").withColumn("delta", F.col("us") - F.col("was"))
    e = seq.rolling_upper_median(e, ["user_id"], "event_id", "delta", 31, "median", 3)
    return e.where("delta > 4 * median and delta > 1000000").select("event_id", "user_id", "delta", "median")


@query
def band_correlation(spark, d):
    """Errors and purchases of one PID at most 40 events apart."""
    e = events(spark, d).withColumn("pid", F.pmod("user_id", F.lit(64)))
    a = e.where("event_type = 'error'").select("pid", F.col("event_id").alias("error_id"))
    b = e.where("event_type = 'purchase'").select("pid", F.col("event_id").alias("purchase_id"))
    return seq.band_join(a, b, ["pid"], "error_id", "purchase_id", 400).select("pid", "error_id", "purchase_id")


@query
def incident_cluster(spark, d):
    """Stretches of errors less than 8 events apart that touch at least three PIDs."""
    e = events(spark, d).where("event_type = 'error'").select((F.floor(F.col("event_id") / 100_000)).alias("shard"), F.col("event_id").alias("start_id"), F.col("event_id").alias("end_id"), F.pmod("user_id", F.lit(8)).alias("pid"))
    e = seq.scan(e, [], "start_id", lags={"was": F.col("start_id")})
    e = seq.scan(e, [], "start_id", sums={"run": (F.col("was").isNull() | (F.col("start_id") - F.col("was") > 8)).cast("long")})
    g = e.groupBy("run").agg(F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"), F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("pids"))
    return g.where("pids >= 3").drop("run")


def _ranges(spark, d) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("a"), F.pmod("o_orderkey", F.lit(90)).alias("len"))
    return o.select("o_custkey", "a", (F.col("a") + F.col("len")).alias("b"))


@query
def merge_intervals(spark, d):
    return seq.merge_intervals(_ranges(spark, d), ["o_custkey"], "a", "b")


@query
def union_size(spark, d):
    m = seq.merge_intervals(_ranges(spark, d), ["o_custkey"], "a", "b")
    return m.groupBy("o_custkey").agg(F.sum(F.col("b") - F.col("a")).alias("days"), F.count(F.lit(1)).alias("parts"))


@query
def coverage_subtraction(spark, d):
    """Errors that no purchase of the same user covers (within 200 events before): a left anti range join."""
    e = events(spark, d)
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("x"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("y"))
    hit = seq.band_join(a, b, ["user_id"], "x", "y", 2000).where("y <= x").select("user_id", "x").distinct()
    return a.join(hit, ["user_id", "x"], "left_anti").select("user_id", F.col("x").alias("event_id"))


def _clips(spark) -> DataFrame:
    return spark.range(1, 41).select(F.col("id").alias("clip"), (F.col("id") * 200).alias("a"), (F.col("id") * 200 + 60 + F.col("id")).alias("b"))


@query
def clip_shift(spark, d):
    """Rows inside clips, renumbered so that clips follow one another without holes."""
    c = _clips(spark)
    w = Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("before", F.coalesce(F.sum(F.col("b") - F.col("a")).over(w), F.lit(0)))
    e = events(spark, d).select("event_id")
    return e.join(F.broadcast(c), (F.col("event_id") >= F.col("a")) & (F.col("event_id") < F.col("b"))).select("clip", "event_id", (F.col("event_id") - F.col("a") + F.col("before")).alias("position"))


@query
def anchor4_match(spark, d):
    """Places at which four events of one stretch recur in another."""
    e = events(spark, d).select("event_id", F.concat("event_type", (F.col("user_id") % 4).cast("string")).alias("token"))
    a = e.where("event_id < 400")
    b = e.where("event_id >= 400 and event_id < 5000")
    return seq.ngram_matches(a, b, 4, "event_id", "token")


@query
def binary_overlap(spark, d):
    """The longest suffix of one sequence that is a prefix of another."""
    e = events(spark, d).select("event_id", "user_id", "event_type")
    a = e.where("event_id < 700").select(F.col("event_id").alias("i"), F.xxhash64("user_id", "event_type").alias("h"))
    b = e.where("event_id >= 450 and event_id < 1200").select((F.col("event_id") - 450).alias("j"), F.xxhash64("user_id", "event_type").alias("h"))
    size = a.agg((F.max("i") + 1).alias("n"))
    m = a.join(b, "h").withColumn("shift", F.col("i") - F.col("j")).groupBy("shift").agg(F.count(F.lit(1)).alias("equal"), F.min("j").alias("low"))
    m = m.crossJoin(F.broadcast(size)).where("low = 0 and equal = n - shift and equal >= 32")
    return m.agg(F.max("equal").alias("overlap"))


def _halves(spark, d, *cols: Column) -> tuple[DataFrame, DataFrame]:
    """All events in order, numbered without holes in ``at`` and cut in the middle; ``n`` is the first half's length."""
    e = seq.scan(events(spark, d).select("event_id", *cols), [], "event_id", sums={"at": F.lit(1).cast("long")}).withColumn("at", F.col("at") - 1)
    e = e.crossJoin(F.broadcast(e.agg(F.floor(F.count(F.lit(1)) / 2).alias("n"))))
    return e.where("at < n"), e.where("at >= n")


@query
def anchor4_match_whole(spark, d):
    """Places (in event order, from 0) in the first half of all events at which four events recur in the second half. The SQL of
    anchor4_match holds for a window of the table only; here no event is left out, and finer tokens keep the join small."""
    a, b = _halves(spark, d, F.concat("event_type", (F.col("user_id") % 64).cast("string")).alias("token"))
    return seq.ngram_matches(a, b, 4, "at", "token")


#: Primes whose products fit a long, and the bases of the powers that weigh a position.
_MODULI = ((2147483647, 1103515245), (2147483629, 1664525))


def _power(base: int, i: Column, p: int) -> Column:
    """base ** i modulo p, for i up to 40 bits."""
    out = F.lit(1).cast("long")
    for k in range(40):
        out = out * F.when(F.shiftright(i, k).bitwiseAND(1) == 1, pow(base, 1 << k, p)).otherwise(1) % p
    return out


@query
def binary_overlap_whole(spark, d):
    """The longest suffix of the first half of all events that is a prefix of the second, 32 at least, null if there is none. Each length is
    one row: weighted running sums of both halves (modulo two primes, 62 bits together) are equal if the stretches are."""
    a, b = _halves(spark, d, F.xxhash64("user_id", "event_type").alias("h"))
    a = a.select(F.col("at").alias("i"), "n", "h")
    b = b.select((F.col("at") - F.col("n")).alias("i"), "h")
    term = lambda p, r: F.pmod("h", F.lit(p)) * _power(r, F.col("i"), p) % p
    sums = {f"s{k}": term(p, r) for k, (p, r) in enumerate(_MODULI)}
    a = seq.scan(a, [], "i", sums=sums).withColumns({f"t{k}": F.col(f"s{k}") - term(p, r) for k, (p, r) in enumerate(_MODULI)})
    b = seq.scan(b, [], "i", sums=sums).select((F.col("i") + 1).alias("size"), *[F.col(x).alias(f"b_{x}") for x in sums])
    last = a.where("i = n - 1").select(*[F.col(x).alias(f"all_{x}") for x in sums])
    m = a.withColumn("size", F.col("n") - F.col("i")).where("size >= 32").crossJoin(F.broadcast(last)).join(b, "size")
    for k, (p, r) in enumerate(_MODULI):
        m = m.where((F.col(f"all_s{k}") - F.col(f"t{k}")) % p == _power(r, F.col("i"), p) * (F.col(f"b_s{k}") % p) % p)
    return m.agg(F.max("size").alias("overlap"))


@query
def donor_choice(spark, d):
    li = read_table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.round(F.col("l_quantity")).cast("long")).alias("q"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("errors"))
    return seq.best(li, ["l_partkey"], [F.col("errors"), -F.col("q"), F.col("l_suppkey")], ["l_suppkey", "errors", "q"])


@query
def coverage_matrix(spark, d):
    """Parts by the suppliers' quarter, and parts that only one supplier has."""
    li = read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    own = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("l_suppkey")).where("n = 1").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("unique_parts"))
    n = li.withColumn("quarter", F.pmod("l_partkey", F.lit(4))).groupBy("l_suppkey").pivot("quarter", [0, 1, 2, 3]).count()
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return n.join(own, "l_suppkey", "left").select("l_suppkey", *[z(str(i)).alias(f"q{i}") for i in range(4)], z("unique_parts").alias("unique_parts"))


@query
def service_full_outer(spark, d):
    n = read_table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    s = read_table(spark, d, "supplier").where("s_nationkey >= 5").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return n.join(s, n.n_nationkey == s.s_nationkey, "full_outer").select(F.coalesce("n_nationkey", "s_nationkey").alias("service_id"), F.col("n_name").alias("name"), "suppliers")


@query
def set_union_append(spark, d):
    """Two files one after the other, with the position of each row in the whole."""
    o = read_table(spark, d, "orders").select("o_orderkey")
    both = o.withColumn("file", F.lit(0)).unionByName(o.where("o_orderkey % 3 = 0").withColumn("file", F.lit(1)))
    n = o.agg(F.max("o_orderkey").alias("top"))
    at = both.crossJoin(F.broadcast(n)).withColumn("order", F.col("file") * (F.col("top") + 1) + F.col("o_orderkey"))
    out = seq.scan(at, [], "order", sums={"position": F.lit(1).cast("long")})
    return out.select("file", "o_orderkey", (F.col("position") - 1).alias("position"))


@query
def cc_renumber(spark, d):
    """One fixed counter offset per PID and stretch, so that stretches join and gaps inside them stay."""
    p = decoded(spark, d).where("not tei").withColumn("part", F.floor(F.col("event_id") / 2500))
    ends = p.groupBy("pid", "part").agg(F.min_by("cc", "event_id").alias("first"), F.max_by("cc", "event_id").alias("last"))
    w = Window.partitionBy("pid").orderBy("part")
    # the offset of a stretch is the sum of the corrections at all seams up to it
    seam = F.coalesce(F.lag("last").over(w) + 1 - F.col("first"), F.lit(0))
    ends = ends.withColumn("seam", seam).withColumn("offset", F.sum("seam").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("pid", "part", "offset")
    return p.join(ends, ["pid", "part"]).select("event_id", "pid", F.pmod(F.col("cc") + F.col("offset"), F.lit(16)).cast("int").alias("cc"))


@query
def slot_spread(spark, d):
    """Reference slots over which 7 packets for every 5 are spread."""
    o = read_table(spark, d, "orders").select("o_orderkey")
    o = seq.scan(o, [], "o_orderkey", sums={"seen": F.lit(1).cast("long")})
    return o.select("o_orderkey", F.ceil(F.col("seen") * 5 / 7.0).cast("long").alias("slot"))


@query
def natural_sort(spark, d):
    """Rank of names under natural order; one rank per name."""
    n = read_table(spark, d, "supplier").select(F.concat(F.lit("Part"), (F.col("s_suppkey") % 50).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".ts").otherwise("b02.ts")).alias("name")).distinct()
    return n.select("name", F.rank().over(Window.orderBy(text.natural_key(F.col("name")))).cast("long").alias("place"))


@query
def next_same_key(spark, d):
    e = seq.scan(events(spark, d), ["user_id"], "event_id", lags={"previous_id": F.col("event_id")}).withColumn("back", -F.col("event_id"))
    e = seq.scan(e, ["user_id"], "back", lags={"next_id": F.col("event_id")})
    return e.select("event_id", "previous_id", "next_id")


@query
def packet_window(spark, d):
    return decoded(spark, d).where("event_id between 500 and 563").select("event_id", "pid", "cc", "tei")


@query
def formats(spark, d):
    li = read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    ms = F.col("l_partkey") * 987_654
    return li.select("l_partkey", "l_suppkey", text.hex_pid(F.col("l_partkey") % 8192).alias("pid_text"), text.clock_text(ms).alias("time_text"), text.clock_text(ms, True).alias("day_text"))


@query
def size_format(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_partkey") * 1024).alias("n"))
    return p.select("p_partkey", text.size_text(F.col("n")).alias("size_text"))


@query
def parse_literals(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" 0x"), F.hex("p_partkey"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_partkey").cast("string"), F.lit(" "))).otherwise(F.lit("x1")).alias("t"))
    return p.select("p_partkey", text.parse_number(F.col("t")).alias("number"))


@query
def mjd_to_utc(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", (40_000 + F.col("o_orderkey") % 20_000).alias("mjd"))
    return o.select("o_orderkey", F.date_format(text.mjd_to_date(F.col("mjd")), "yyyy-MM-dd").alias("day"))


@query
def context_range(spark, d):
    """Fifteen seconds around each error at 1,000 packets a second, clamped to the stream."""
    e = events(spark, d)
    n = e.agg((F.max("event_id")).alias("top"))
    e = e.where("event_type = 'error'").crossJoin(F.broadcast(n))
    return e.select("event_id", F.greatest(F.lit(0), F.col("event_id") - 150).cast("long").alias("start_id"), F.least(F.col("top"), F.col("event_id") + 150).alias("end_id"))


@query
def anomaly_markers(spark, d):
    """One marker per pixel: the highest severity, the first at ties."""
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    e = events(spark, d).select(F.floor(F.col("event_id") / 50).alias("pixel"), "event_id", rank.alias("severity"))
    return seq.best(e, ["pixel"], [-F.col("severity"), F.col("event_id")], ["severity", "event_id"])


@query
def anchor_thinning(spark, d):
    """Every second anchor of a user, with the first and the last."""
    e = events(spark, d).where("event_type = 'view'").select("event_id", "user_id")
    e = seq.scan(e, ["user_id"], "event_id", sums={"nth": F.lit(1).cast("long")})
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    return e.join(last, "user_id").where("nth % 2 = 1 or event_id = last_id").select("user_id", "event_id")


@query
def avg_peak_bitrate(spark, d):
    b = _buckets(spark, d)
    return b.agg(F.sum(F.col("packets") * 1504).alias("bits"), F.max(F.col("packets") * 1504).alias("peak_bits"), F.count(F.lit(1)).alias("buckets"))


@query
def missing_structure(spark, d):
    """Customers of the catalog without any order: a left anti join."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query
def event_reach(spark, d):
    """Errors with how many users had one in the 30 events up to them: a distinct count over a range, by cells instead of a global window."""
    e = events(spark, d).where("event_type = 'error'").select("event_id", "user_id")
    pairs = seq.band_join(e.select(F.col("event_id").alias("x"), F.lit(0).alias("k")), e.select(F.col("event_id").alias("y"), "user_id", F.lit(0).alias("k")), ["k"], "x", "y", 30).where("y <= x")
    return pairs.groupBy("x").agg(F.countDistinct("user_id").alias("users")).select(F.col("x").alias("event_id"), "users")
