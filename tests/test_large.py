from packetloom.functions import packet, synth
from packetloom.operators import detect, edit, large, repair, summary
from packetloom.plans import quick_check
from tests.test_quick_check import head, table


def frames(numbers, pid=0x100, base=0, cc=0, extra=0):
    """Two packets a frame: its content tells its number."""
    out = []
    for i in numbers:
        body = bytes((i * 17 + k) % 256 for k in range(300 + extra))
        data = synth.pes(0xE0, base + 3600 * i, body, length=0 if not extra else len(body) + 8)
        for part in (data[:184], data[184:]):
            out.append(synth.packet(pid, cc, part, pusi=part is not data[184:] and part[:3] == b"\0\0\1"))
            cc += 1
    return out


def units(p):
    rows = detect.continuity_rows(p)
    pids = [r.pid for r in p.select("pid").distinct().collect() if 0x100 <= r.pid < 0x1000]
    return repair.pes_units(p, edit.extract_elementary(p, rows, pids))


def laid(df):
    return [bytes(r.raw) for r in df.orderBy("packet_index", "sub_index").collect()]


def still(df):
    """The rows as a plain table: short plans for what follows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def damage(p):
    rows = detect.continuity_rows(p)
    return rows.where("fault in ('Gap', 'ConflictingDuplicate')").select("path", "pid", "packet_index").unionByName(p.where("tei").select("path", "pid", "packet_index"))


def test_a_large_gap_is_filled(spark):
    whole = head() + frames(range(120))
    cut = head() + frames(range(40)) + frames(range(80, 120), cc=5)
    donor = head() + frames(range(120), pid=0x200, base=1_000_000, cc=7)
    worse = head() + frames(range(60), pid=0x200) + [synth.packet(0x200, 0, tei=True)] + frames(range(60, 120), pid=0x200, cc=9)
    p, d, w = (packet.decode(table(spark, x, n)) for x, n in ((cut, "ref"), (donor, "don"), (worse, "bad")))
    p, d, w = still(p), still(d), still(w)
    gaps = still(repair.large_gaps(detect.clock_rows(p, "pts")))
    assert gaps.count() == 1
    tracks = spark.createDataFrame([(0x100, "don", 0x200), (0x100, "bad", 0x200)], "pid int, donor_path string, donor_pid int")
    both = d.unionByName(w)
    found = still(large.candidates(gaps, still(units(p)), still(units(both)), tracks, still(damage(both))))
    (c,) = found.collect()
    assert (c.donor_path, c.first, c.stop, c.offset) == ("don", 2 + 80, 2 + 160, -1_000_000)
    chosen = still(large.choose(found, spark.createDataFrame([("don", 0)], "donor_path string, errors int")))
    out = laid(large.insert(p, chosen, d))
    assert out == whole
    before, after = (quick_check.check_packets(table(spark, x), ("continuity", "timestamps")).events for x in (cut, out))
    assert repair.improved(before, after, 1) and after.where("severity = 'Error'").count() == 0
    issues = spark.createDataFrame([("ref", 0x100, 1, 80, 84), ("ref", 0x100, 2, 83, 90), ("ref", 0x101, 3, 0, 1)], "path string, pid int, issue_id int, start_packet long, end_packet long")
    items = spark.createDataFrame([("ref", 0x100, 9, 78, 85)], "path string, pid int, item_id int, start_packet long, end_packet long")
    assert sorted((r.issue_id, r.status, r.item_id) for r in large.status(issues, items).collect()) == [(1, "Repaired", 9), (2, "PartlyRepaired", 9), (3, "Open", None)]


def test_an_incident_takes_one_donor_for_all_tracks(spark):
    cols = "path string, pid int, packet_index long, last_packet long, start_t long, end_t long, delta long, donor_path string, donor_pid int, first long, stop long, offset long"
    rows = [("r", 1, 50, 40, 1000, 9000, 8000, d, 1, f, f + 9, 0) for d, f in (("a", 3), ("b", 5), ("b", 4))] + [("r", 2, 51, 41, 2000, 9000, 7000, "b", 2, 7, 9, 0), ("r", 1, 90, 80, 900_000, 990_000, 90_000, "a", 1, 1, 2, 0)]
    got = large.choose(spark.createDataFrame(rows, cols), spark.createDataFrame([("b", 5)], "donor_path string, errors int")).collect()
    assert sorted((r.pid, r.packet_index, r.donor_path, r.first) for r in got) == [(1, 50, "b", 4), (1, 90, "a", 1), (2, 51, "b", 7)]


def test_regions_are_replaced_in_proportion(spark):
    good = frames(range(20))
    hurt = [x if not 16 <= i < 24 else synth.packet(0x100, i, tei=True) for i, x in enumerate(good) if i not in (20, 21)]
    p, d = still(packet.decode(table(spark, hurt, "ref"))), still(packet.decode(table(spark, good, "don")))
    regions = spark.createDataFrame([("ref", 0x100, 16, 22, "don", 0x100, 16, 24, 0)], "path string, pid int, start_packet long, end_packet long, donor_path string, donor_pid int, first long, stop long, offset long")
    out = still(large.replace(p, regions, d))
    assert laid(out) == good
    assert sorted(r.packet_index for r in out.where("packet_index between 16 and 21").collect()) == [16, 16, 17, 18, 19, 19, 20, 21]
    found = spark.createDataFrame([(1, 1, "a", 1, 5, 9, 2), (1, 1, "b", 1, 5, 9, 3), (1, 1, "c", 1, 4, 9, 3)], "pid int, region_id int, donor_path string, donor_pid int, start_packet long, end_packet long, matches int")
    assert [(r.donor_path) for r in large.best_region(found, spark.createDataFrame([("b", 1)], "donor_path string, errors int")).collect()] == ["c"]
    windows = spark.createDataFrame([("r", 1, 1, -5, 0, "a", 3), ("r", 1, 1, 4, 9, "a", 7), ("r", 1, 1, 4, -1, "b", 8)], "path string, pid int, gap_id int, time_distance long, packet_distance long, donor_path string, at long")
    assert [(r.donor_path, r["at"]) for r in large.best_window(windows).collect()] == [("b", 8)]


def test_differing_islands(spark):
    def table_(*windows):
        return spark.createDataFrame([(w, i, x) for w, text in enumerate(windows) for i, x in enumerate(text, 1)], "window int, nth long, signature string")

    a, b = table_("abXYde", "abc", "aab", "ab"), table_("abQde", "abc", "aaab", "xaby")
    got = {r.window: (r.first, r.last, r.donor_first, r.donor_last) for r in large.differing(a, b).collect()}
    assert got == {0: (3, 4, 3, 3), 1: (None, None, None, None), 2: (3, 2, 3, 3), 3: (1, 2, 1, 4)}


def test_links_normalisation_and_remaining_bytes(spark):
    seg = spark.createDataFrame([("a", 1, "PersistentClockDiscontinuity", 100, None, 0, None, 450_000.0), ("a", 2, "GradualPcrDrift", 50, 150, 0, 0, -90_000.0)], repair.SEGMENTS)
    events = spark.createDataFrame([("a", "PtsJump", 9000, 5.2), ("a", "PtsJump", 40_000, 1.0), ("a", "PcrJump", 60, 1.0)], "path string, type string, packet_index long, arg1 double")
    assert {r.pid: r.affects_timestamps for r in large.linked(seg, events).collect()} == {1: True, 2: False}
    rows = spark.createDataFrame([("a", 10, 1000), ("a", 100, 1000), ("a", 200, 1000), ("b", 100, 5)], "path string, packet_index long, t long")
    got = {(r.path, r.packet_index): r.t for r in repair.normalised(rows, seg, "t").collect()}
    assert got == {("a", 10): 1000, ("a", 100): 1000 - 450_000 + 45_000, ("a", 200): 1000 - 450_000, ("b", 100): 5}
    raws = head() + frames(range(3), extra=1) + [synth.packet(0x100, 9)]
    c = quick_check.check_packets(table(spark, raws), ("continuity",))
    left = [r.remaining for r in detect.remaining_bytes(c.packets, detect.continuity_rows(c.packets), c.catalog).where("pid = 256").orderBy("packet_index").collect()]
    assert left == [315 - 184, 0] * 3 + [None]


def test_display_time_and_bucket_rates(spark):
    raws = head() + [synth.packet(0x100, i, pcr=90_000 * (i // 10) if i % 10 == 0 else None) for i in range(35)]
    c = quick_check.check_packets(table(spark, raws), ())
    spans = still(summary.clock_spans(c.pcr, c.catalog))
    at = spark.createDataFrame([("a.ts", i) for i in (0, 2, 7, 22, 36)], "path string, packet_index long")
    assert {r.packet_index: r.display_s for r in summary.display_times(at, spans).collect()} == {0: None, 2: 0.0, 7: 0.5, 22: 2.0, 36: 3.4}
    rate = summary.bitrate_at(spark.createDataFrame([("a.ts", 0.5), ("a.ts", 2.99), ("a.ts", 99.0)], "path string, time_s double"), still(c.timeline()))
    assert {r.time_s: (r.start_s, r.bucket_bitrate) for r in rate.collect()} == {0.5: (0.0, 15040.0), 2.99: (2.0, 15040.0), 99.0: (None, None)}
