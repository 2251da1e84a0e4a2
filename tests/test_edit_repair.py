import pytest
from pyspark.sql import functions as F

from packetloom.functions import packet, psi, synth
from packetloom.operators import catalog, detect, edit, repair
from packetloom.plans import quick_check
from tests.test_quick_check import head, kinds, table


def laid(df):
    return [bytes(r.raw) for r in df.orderBy("packet_index", "sub_index").collect()]


def decoded(spark, raws, path="a.ts"):
    return packet.decode(table(spark, raws, path))


def test_clips_join_in_time_and_counters(spark):
    raws = [synth.packet(0x100, i, synth.pes(0xE0, 9000 * i), pusi=True, pcr=9000 * i) for i in range(30)]
    raws[25] = synth.packet(0x100, 27, synth.pes(0xE0, 9000 * 25), pusi=True, pcr=9000 * 25)
    out = laid(edit.merge_clips(decoded(spark, raws), [(0, 10), (20, 30)]))
    assert len(out) == 20 and out[9][3] & 15 == 9 and out[10][3] & 15 == 10
    rows = decoded(spark, out).orderBy("packet_index").collect()
    assert [r.pcr_base for r in rows] == [9000 * i for i in range(20)] == [r.pts for r in rows]
    assert kinds(quick_check.check_packets(table(spark, out), ("continuity", "clocks"))) == {"ContinuityGap": 2}
    assert len(laid(edit.merge_clips(decoded(spark, raws), [(5, 15), (0, 10)]))) == 15


def test_filter_split_and_remap(spark):
    pmts = {1: 0x1000, 2: 0x1001}
    raws = psi.packetize(psi.build_pat(1, 0, pmts), 0, 0)
    for n, pid in pmts.items():
        raws += psi.packetize(psi.build_pmt(n, 0, 0x100 * n, [(0x1B, 0x100 * n, b""), (0x0F, 0x100 * n + 1, b"\x0a\x04eng\0")]), pid, 0)
    for i in range(20):
        raws += [synth.packet(pid, i, pcr=3000 * i if pid in (0x100, 0x200) else None) for pid in (0x100, 0x101, 0x200, 0x201)]
    p = decoded(spark, raws).cache()
    c = catalog.build(p)
    audio = decoded(spark, laid(edit.filter_streams(p, c, {0x101})))
    back = catalog.build(audio)
    assert {r.pid for r in back.streams.collect()} == {0x101} and {r.program_number for r in back.programs.collect()} == {1}
    only = {r.pid: r.n for r in audio.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert only == {0: 1, 0x1000: 1, 0x101: 20, 0x100: 20}
    assert audio.where("pid = 256 and pcr_base is not null and not has_payload").count() == 20
    parts = edit.split_services(p, c, [1, 2])
    assert {r.service_id: r.n for r in parts.groupBy("service_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 42, 2: 42}
    out = decoded(spark, laid(edit.remap(p, c, {0x200: 0x300, 0x201: 0x301}, services={2: 7}, languages={0x201: "fra"}, preserve_count=True)))
    new = catalog.build(out)
    assert out.count() == len(raws) and {(r.program_number, r.pid, r.language) for r in new.streams.collect()} == {(7, 0x300, None), (7, 0x301, "fra")}
    with pytest.raises(ValueError):
        edit.remap(p, c, {0x200: 0x10})


def test_elementary_streams(spark):
    body = [bytes([k]) * 300 for k in range(4)]
    raws, cc = [], 0
    for k in range(4):
        data = synth.pes(0xE0, 9000 * k, body[k])
        for i in range(0, len(data), 184):
            raws.append(synth.packet(0x100, cc, data[i : i + 184], pusi=i == 0))
            cc += 1
    rows = lambda r: (p := decoded(spark, r), detect.continuity_rows(p))
    es = lambda r: b"".join(bytes(x.payload) for x in edit.extract_elementary(*rows(r), [0x100]).orderBy("packet_index").collect())
    assert es(raws) == b"".join(body)
    assert es([raws[0], raws[0], *raws[1:]]) == b"".join(body)
    assert es(raws[:3] + raws[4:]) == body[0] + body[1][:170] + body[2] + body[3]
    split = [synth.packet(0x100, 0, synth.pes(0xE0, 5, b"")[:7], pusi=True), synth.packet(0x100, 1, synth.pes(0xE0, 5, b"abc")[7:])]
    assert es(split) == b"abc"


def test_files_merge_at_their_overlap(spark):
    raws = [bytes([0x47, 1, i & 255, 0x10]) + i.to_bytes(4, "little") + bytes((i * 31 + k * 17) & 255 for k in range(180)) for i in range(300)]
    a, b = table(spark, raws[:200]), table(spark, raws[120:])
    assert edit.overlap(a, b) == 80
    assert laid(edit.merge_files([a, b])) == raws
    assert laid(edit.merge_files([a, table(spark, raws[150:200]), b])) == raws
    with pytest.raises(ValueError):
        edit.merge_files([table(spark, raws[:50]), table(spark, raws[60:])])


def clock_table(spark, offset):
    raws = head() + [synth.packet(0x100, i, synth.pes(0xE0, t := 9000 * (i // 10) + offset(i // 10)) if i % 10 == 0 else None, pusi=i % 10 == 0, pcr=t if i % 10 == 0 else None) for i in range(1500)]
    return table(spark, raws)


@pytest.mark.parametrize(("offset", "kind"), [
    (lambda s: 0, None), (lambda s: 450_000 if 50 <= s < 80 else 0, "TemporaryPcrOffset"), (lambda s: (s - 50) * 9000 if 50 <= s < 100 else 0, "GradualPcrDrift"), (lambda s: 450_000 if s >= 50 else 0, "PersistentClockDiscontinuity"),
])
def test_timelines(spark, offset, kind):
    check = quick_check.check_packets(clock_table(spark, offset), ("clocks",))
    found = repair.timeline_segments(check.pcr).collect()
    assert [r.kind for r in found] == ([kind] if kind else [])
    if kind in ("TemporaryPcrOffset", "PersistentClockDiscontinuity"):
        fixed = edit.shift_timestamps(repair.corrections(check.packets, repair.timeline_segments(check.pcr), check.catalog), "clock", "stamps")
        again = quick_check.check_packets(fixed.select("path", "packet_index", "file_offset", "raw"), ("clocks",))
        assert again.events.where("type like 'Pcr%'").count() == 0


def test_gap_is_filled_from_a_donor(spark):
    raws = [synth.packet(0x100, i, bytes([i]) * 184) for i in range(60)]
    ref, donor = raws[:20] + raws[25:], [synth.packet(0x200, i + 5, bytes([i]) * 184) for i in range(60)]
    p, d = decoded(spark, ref, "ref"), decoded(spark, donor, "don")
    faults, other = detect.continuity_rows(p), detect.continuity_rows(d)
    tracks = spark.createDataFrame([(0x100, "don", 0x200)], "pid int, donor_path string, donor_pid int")
    c = repair.gap_candidates(repair.gaps(faults), other, tracks)
    chosen = repair.choose(c, spark.createDataFrame([("don", 0)], "donor_path string, errors int"))
    whole = edit._plain(p).unionByName(repair.insertions(chosen, other))
    assert laid(whole) == raws
    before, after = (quick_check.check_packets(table(spark, r), ("continuity",)).events for r in (ref, laid(whole)))
    assert repair.improved(before, after, 1)


def test_large_gaps_and_tracks(spark):
    raws = [synth.packet(0x100, i, synth.pes(0xE0, 3600 * (i if i < 40 else i + 40)), pusi=True) for i in range(80)]
    g = repair.large_gaps(detect.clock_rows(decoded(spark, raws), "pts")).collect()
    assert [(r.last_packet, r.packet_index, r.delta) for r in g] == [(39, 40, 3600 * 41)]
    cols = "path string, program_number int, pid int, stream_type int, supplement string, language string"
    a = spark.createDataFrame([("a", 1, 1, 27, None, None), ("a", 1, 2, 15, None, "eng")], cols)
    b = spark.createDataFrame([("b", 1, 9, 27, None, None), ("b", 1, 2, 15, None, "eng"), ("b", 1, 3, 15, None, "fra"), ("b", 1, 4, 15, None, None)], cols)
    assert sorted((r.pid, r.donor_pid, r.rank, r.ambiguous) for r in repair.track_mapping(a, b).collect()) == [(1, 9, 1, False), (2, 2, 1, False)]
    # another program: no direct match, so all stay in order; case and blanks of languages do not count
    a = spark.createDataFrame([("a", 1, 2, 15, None, "ENG"), ("a", 1, 5, 15, None, "deu")], cols)
    b = spark.createDataFrame([("b", 7, 2, 15, None, "eng"), ("b", 1, 8, 15, None, " "), ("b", 7, 3, 15, None, "fra")], cols)
    assert sorted((r.pid, r.rank, r.donor_pid, r.ambiguous) for r in repair.track_mapping(a, b).collect()) == [(2, 1, 8, True), (2, 2, 2, True), (5, 1, 8, True)]
