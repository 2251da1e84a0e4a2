import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.functions import psi, synth
from packetloom.operators import detect, edit, summary
from packetloom.plans import quick_check
from packetloom.sources import mpegts


def table(spark, raws, path="a.ts"):
    return spark.createDataFrame([(path, i, i * 188, bytearray(r)) for i, r in enumerate(raws)], "path string, packet_index long, file_offset long, raw binary").repartition(3)


def head():
    return psi.packetize(psi.build_pat(1, 0, {1: 0x1000}), 0, 0) + psi.packetize(psi.build_pmt(1, 0, 0x100, [(0x1B, 0x100, b""), (0x0F, 0x101, b"\x0a\x04eng\0")]), 0x1000, 0)


def kinds(check):
    out = {}
    for r in check.events.select("type", "pid").collect():
        out[r.type] = out.get(r.type, 0) + 1
    return out


FEW = ("continuity", "clocks")


def test_transport_errors_do_not_cascade(spark):
    raws = [synth.packet(0x100, i) for i in range(4)] + [synth.packet(0x100, 9, tei=True, afc=0), synth.packet(0x100, 9, tei=True, pcr=4_000_000_000)] + [synth.packet(0x100, i) for i in (6, 7)]
    assert kinds(quick_check.check_packets(table(spark, raws), FEW)) == {"TransportError": 2}


def test_counter_faults(spark):
    a = [synth.packet(0x100, c) for c in (0, 1, 2, 4, 5, 5, 6)] + [synth.packet(0x100, 6, fill=1), synth.packet(0x100, 12, disc=True), synth.packet(0x100, 13)]
    c = quick_check.check_packets(table(spark, a), FEW)
    assert kinds(c) == {"ContinuityGap": 1, "DuplicatePacket": 1, "ConflictingDuplicate": 1}
    r = c.pids.where("pid = 256").first()
    assert (r.packet_count, r.continuity_errors, r.duplicate_packets) == (10, 2, 1)


def test_clock_jump_survives_a_transport_error(spark):
    raws = [synth.packet(0x100, i, pcr=90_000 + 3000 * i) for i in range(2)] + [synth.packet(0x100, 2, tei=True), synth.packet(0x100, 3, pcr=2_000_000)]
    assert kinds(quick_check.check_packets(table(spark, raws), ("clocks",))) == {"TransportError": 1, "PcrJump": 1}


def test_scrambling_and_wraps(spark):
    raws = [synth.packet(0x100, i, tsc=i) for i in range(4)] + [synth.packet(0x102, i, pcr=2**33 - 3000 + 3000 * i) for i in range(4)]
    c = quick_check.check_packets(table(spark, raws), ("clocks",))
    assert c.pids.where("pid = 256").first().scrambled_payload_packets == 2
    assert c.events.count() == 0


def test_catalog_and_pes_sizes(spark):
    raws = head()
    cc = 0
    for k, extra in enumerate((0, 4, 0, 0)):
        body = bytes(170 + 184)
        data = synth.pes(0xE0, 90_000 * k, body, length=len(body) + 8 + extra)
        for i in range(0, len(data), 184):
            raws.append(synth.packet(0x100, cc, data[i : i + 184], pusi=i == 0))
            cc += 1
    c = quick_check.check_packets(table(spark, raws), ("continuity", "pes", "structure", "psi", "timestamps"))
    assert [(r.program_number, r.pmt_pid, r.pcr_pid) for r in c.catalog.programs.collect()] == [(1, 0x1000, 0x100)]
    assert {(r.pid, r.stream_name, r.language) for r in c.catalog.streams.collect()} == {(0x100, "H264", None), (0x101, "Aac", "eng")}
    assert kinds(c) == {"PesSizeMismatch": 1, "MissingPcr": 1}
    assert c.verdict() == "Error" and "PID 0x0100 H264" in c.report()


def test_events_merge_per_pid(spark):
    raws = [synth.packet(0x100 + i % 2, i // 2, tei=i in (2, 3, 4, 5)) for i in range(10)]
    merged = quick_check.check_packets(table(spark, raws), FEW).merged.where("type = 'TransportError'").collect()
    assert sorted((r.pid, r.occurrences) for r in merged) == [(0x100, 2), (0x101, 2)]


def test_bitrate_timeline_and_candidates(spark):
    raws, n = head(), [0, 0]
    for i in range(1000):
        k = i % 4 == 3
        pcr = 9000 * (i // 100) + 90_000 if i % 100 == 0 else None
        raws.append(synth.packet(0x101 if k else 0x100, n[k], pcr=pcr))
        n[k] += 1
    c = quick_check.check_packets(table(spark, raws), ("clocks",))
    rate = {r.pid: (r.total_bitrate, r.bitrate) for r in c.bitrate().collect()}
    assert 1.500e6 <= rate[0x100][0] <= 1.508e6 and 2.9 <= rate[0x100][1] / rate[0x101][1] <= 3.1
    b = c.timeline().collect()
    assert len(b) == 1 and b[0].total_packets == pytest.approx(900) and b[0].duration_s == 1.0
    assert c.candidates().count() == 0
    jump = [synth.packet(0x100, i, pcr=9000 * i + (120_000 if i >= 6 else 0)) for i in range(12)]
    assert quick_check.check_packets(table(spark, head() + jump), ("clocks",)).candidates().count() == 1


def test_av_drift(spark):
    for step, want in ((0, False), (54_000, True)):
        raws, cc = head(), {0x100: 0, 0x101: 0}
        for s in range(16):
            t = 90_000 * (s + 1)
            for pid, pts in ((0x100, t + 9000), (0x101, t + (step if s > 7 else 0))):
                raws.append(synth.packet(pid, cc[pid], synth.pes(0xE0 if pid == 0x100 else 0xC0, pts), pusi=True, pcr=t if pid == 0x100 else None))
                cc[pid] += 1
        c = quick_check.check_packets(table(spark, raws), ("av_sync",))
        assert bool(c.events.where("type = 'AvSyncDrift'").count()) == want


def test_files_splits_loss_and_writer(spark, tmp_path):
    raws = [synth.packet(0x100, i) for i in range(1000)]
    path = f"{tmp_path}/x.ts"
    open(path, "wb").write(b"junk" + b"".join(raws[:400]) + b"\0" * 77 + b"".join(raws[400:]))
    for split in (64, 100_000):
        rows = mpegts.reindex(mpegts.read(spark, path, split_packets=split)).orderBy("packet_index").collect()
        assert [bytes(r.raw) for r in rows] == raws and [r.packet_index for r in rows] == list(range(1000))
        lost = mpegts.losses(spark, path, split_packets=split).collect()
        assert [(r.start, r.end) for r in lost] == [(4 + 400 * 188, 4 + 400 * 188 + 77)]
    assert mpegts.read(spark, path, on_sync_loss="skip").count() < 1000
    with pytest.raises(Exception, match="sync lost"):
        mpegts.read(spark, path, on_sync_loss="fail").count()
    c = quick_check.check(spark, path, ("continuity",))
    assert kinds(c) == {"SyncLoss": 1}
    good = f"{tmp_path}/y.ts"
    mpegts.write(table(spark, raws), good, partitions=3)
    assert open(good, "rb").read() == b"".join(raws) and len(list(tmp_path.iterdir())) == 2
    window = mpegts.read(spark, good, on_sync_loss="fail", split_packets=100).where("packet_index between 250 and 259")
    assert window.count() == 10
    with pytest.raises(FileExistsError):
        mpegts.write(table(spark, raws), good)


def test_features():
    assert set(FEW) < set(detect.FEATURES)


def args(check, kind):
    return [(r.packet_index, r.code, r.arg1, r.arg2, r.arg3) for r in check.events.where(f"type = '{kind}'").orderBy("packet_index").collect()]


def test_arguments_of_events(spark):
    raws = head() + [synth.packet(0x100, c) for c in (0, 1, 1, 4)] + [synth.packet(0x100, 4, fill=1)]
    raws += [synth.packet(0x100, 5 + i, pcr=t) for i, t in enumerate((900_000, 450_000, 1_800_000, 1_890_000))]
    c = quick_check.check_packets(table(spark, raws), ("continuity", "clocks"))
    assert args(c, "DuplicatePacket") == [(4, "DuplicatePacket", 1, None, None)] and args(c, "ConflictingDuplicate") == [(6, "ConflictingDuplicate", 4, None, None)]
    assert args(c, "ContinuityGap") == [(5, "ContinuityGap", 2, 4, 2)]
    assert args(c, "PcrBackward") == [(8, "PcrBackward", 5, None, None)] and args(c, "PcrJump") == [(9, "PcrJump", 15, None, None)] and args(c, "PcrGap") == [(10, "PcrGap", 1, None, None)]
    raws = head() + [synth.packet(0x101, i, synth.pes(0xC0, p, dts=d), pusi=True) for i, (p, d) in enumerate(((900_000, 900_000), (450_000, 450_000), (720_000, 810_000)))]
    c = quick_check.check_packets(table(spark, raws), ("timestamps",))
    assert args(c, "PtsBackward") == [(3, "PtsBackward", 5, None, None)] and args(c, "DtsBackward") == [(3, "DtsBackward", 5, None, None)]
    assert args(c, "StreamGap") == [(4, "AudioGap", 3, None, None)] and args(c, "DtsAfterPts") == [(4, "DtsAfterPts", 1, None, None)]


def test_repeated_packets_are_not_judged_twice(spark):
    one = synth.packet(0x101, 0, synth.pes(0xC0, 900_000), pusi=True)
    other = synth.packet(0x101, 0, synth.pes(0xC0, 90_000), pusi=True)
    raws = [*head(), one, other, synth.packet(0x101, 1, synth.pes(0xC0, 903_000), pusi=True)]
    c = quick_check.check_packets(table(spark, raws), ("continuity", "timestamps"))
    assert kinds(c) == {"ConflictingDuplicate": 1}
    # without the check of counters nobody tells a repeat
    assert kinds(quick_check.check_packets(table(spark, raws), ("timestamps",))) == {"PtsBackward": 1, "StreamGap": 1}


def cut(data, first):
    return [data[:first], *[data[i : i + 184] for i in range(first, len(data), 184)]]


def test_headers_over_several_packets(spark):
    raws, cc, at = head(), 0, []
    for k, first in enumerate((184, 3, 5, 9, 12, 100)):
        body = bytes(range(200))
        data = synth.pes(0xC0, 90_000 * (k + 1), body, dts=90_000 * (k + 1), length=len(body) + 13 + (k == 2))
        for i, part in enumerate(cut(data, first)):
            at += [len(raws)] if i == (0 if first >= 19 else 1) else []
            raws.append(synth.packet(0x101, cc, part, pusi=i == 0))
            cc += 1
    c = quick_check.check_packets(table(spark, raws), ("continuity", "pes", "timestamps"))
    assert [x[2:] for x in args(c, "PesSizeMismatch")] == [(213, 214, -1)] and kinds(c) == {"PesSizeMismatch": 1}
    p = detect.with_late_stamps(c.packets, detect.continuity_rows(c.packets), c.catalog)
    got = [(r.packet_index, r.pts, r.dts) for r in p.where("pts is not null").orderBy("packet_index").collect()]
    assert got == [(i, 90_000 * (k + 1), 90_000 * (k + 1)) for k, i in enumerate(at)]
    raws[at[2]] = synth.packet(0x101, 3, b"", tei=True, afc=1)
    c = quick_check.check_packets(table(spark, raws), ("pes", "timestamps"))
    assert detect.late_stamps(c.packets, detect.continuity_rows(c.packets), c.catalog).count() == 3


def test_event_times(spark):
    raws = head() + [synth.packet(0x100, 0, pcr=900_000), synth.packet(0x55, 0, pcr=90_000), synth.packet(0x101, 0, synth.pes(0xC0, 1_800_000), pusi=True)]
    raws += [synth.packet(0x101, 1, tei=True), synth.packet(0x77, 0, tei=True), synth.packet(0x100, 1, pcr=990_000), synth.packet(0x101, 5, tei=True)]
    raws = [synth.packet(0x101, 0, tei=True), *raws]
    c = quick_check.check_packets(table(spark, raws), ("continuity",))
    e = summary.event_times(c.events, c.pcr, detect.clock_rows(c.packets, "pts"), c.catalog)
    got = {r.packet_index: (r.time_s, r.source_time_s) for r in e.where("type = 'TransportError'").collect()}
    # before any clock; the program's clock; the last clock of any; the program's again
    assert got == {0: (None, None), 6: (0.0, 10.0), 7: (0.0, 1.0), 9: (1.0, 11.0)}


def test_pat_keeps_its_identity(spark):
    raws = psi.packetize(psi.build_pat(0x4D2, 31, {1: 0x1000}), 0, 0) + head()[1:] + [synth.packet(0x100, i) for i in range(3)]
    c = quick_check.check_packets(table(spark, raws), ())
    out = edit.filter_streams(c.packets, c.catalog, {0x100}).orderBy("packet_index", "sub_index").collect()
    pat = psi.parse_pat(psi.Assembler().push(bytes(out[0].raw)[4:], True)[0])
    assert (pat["tsid"], pat["version"], pat["programs"]) == (0x4D2, 0, {1: 0x1000})


@settings(max_examples=25, deadline=None)
@given(st.data())
def test_splits_change_nothing(data):
    """Whatever is damaged, inserted or lost, any splits read what one scan reads."""
    r = random.Random(data.draw(st.integers(0, 10**9)))
    body = bytearray()
    for _ in range(r.randrange(5, 60)):
        body += b"\x47" + bytes(r.choice((0x55, 0x47, 0, 255)) for _ in range(187))
    for _ in range(r.randrange(4)):
        j, kind = r.randrange(len(body)), r.randrange(3)
        if kind == 0:
            body[j // 188 * 188] = 0
        elif kind == 1:
            del body[j : j + r.randrange(1, 400)]
        else:
            body[j:j] = bytes(r.choice((0x47, 3)) for _ in range(r.randrange(1, 500)))
    raw = bytes(r.randrange(100) for _ in range(r.randrange(200))) + bytes(body)
    sync = mpegts.find_sync(raw)
    if sync < 0:
        return
    at, packets, lost = sync, [], []
    while at + 188 <= len(raw):
        if raw[at] == 0x47:
            packets.append((at, raw[at : at + 188]))
            at += 188
        else:
            found = mpegts.find_sync(raw[at:])
            lost.append((at, len(raw) if found < 0 else at + found))
            at = lost[-1][1]
    with tempfile.NamedTemporaryFile(suffix=".ts") as file:
        file.write(raw)
        file.flush()
        for step in (1, 2, 10, 1000):
            reader = mpegts.PacketReader({"path": file.name, "split_packets": str(step)})
            rows = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column("file_offset").to_pylist(), b.column("raw").to_pylist(), strict=True)]
            holes = mpegts.PacketReader({"path": file.name, "split_packets": str(step), "table": "losses"})
            assert rows == packets
            assert [x for p in holes.partitions() for b in holes.read(p) for x in zip(b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True)] == lost


def test_bounds_are_pushed_whatever_is_lost(spark, tmp_path):
    raws = [synth.packet(0x100, i) for i in range(1000)]
    path = f"{tmp_path}/x.ts"
    open(path, "wb").write(b"".join(raws[:400]) + b"\0" * 77 + b"".join(raws[400:]))
    every = {r.packet_index: bytes(r.raw) for r in mpegts.read(spark, path).collect()}
    some = mpegts.read(spark, path, split_packets=7).where("packet_index between 395 and 410")
    assert {r.packet_index: bytes(r.raw) for r in some.collect()} == {i: x for i, x in every.items() if 395 <= i <= 410}
