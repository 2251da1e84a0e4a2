import random

import pytest

from packetloom.functions import packet
from packetloom.operators import anchors, detect, edit
from tests.test_quick_check import table


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def test_match_and_layout(spark):
    data = noise(5000)
    before, lost, after = data[:2000], data[2000:2900], data[2900:]
    assert anchors.match(before, after, noise(777, 2) + data, 5) == (777 + 2000, 900)
    assert anchors.match(before, after, data, 4) is None  # five packets at least
    assert anchors.match(before, after, data + data, 5) is None  # not the only place
    assert anchors.match(bytes(500), after, data, 5) is None
    raws = anchors.packetized(lost, 0x100, 3, 5, pusi_at=(360,))
    assert len(raws) == 5 and [r[3] & 15 for r in raws] == [3, 4, 5, 6, 7] and sum(r[1] >> 6 & 1 for r in raws) == 1
    p = packet.decode(table(spark, raws)).orderBy("packet_index").collect()
    assert b"".join(bytes(r.raw[r.payload_offset :]) for r in p) == lost
    with pytest.raises(ValueError):
        anchors.packetized(lost, 0x100, 0, 4)


def test_search_by_time(spark):
    data = noise(40_000, 3)
    donor = spark.createDataFrame([("d", 7, 90_000 * (i // 20), i, bytearray(data[i * 100 : i * 100 + 100])) for i in range(400)], "donor_path string, donor_pid int, t long, packet_index long, payload binary")
    gaps = spark.createDataFrame([("r", 1, 0, 90_000 * 5, bytearray(data[9000:10_000]), bytearray(data[10_400:11_000]), 3, "None", "d", 7), ("r", 1, 1, 90_000 * 15, bytearray(data[9000:10_000]), bytearray(data[10_400:11_000]), 3, "None", "d", 7)],
                                  "path string, pid int, gap_id long, t long, before binary, after binary, missing int, kind string, donor_path string, donor_pid int")
    got = anchors.search(gaps, donor).collect()
    assert [(r.gap_id, bytes(r.payload)) for r in got] == [(0, data[10_000:10_400])]


def test_regions_identity_and_times(spark):
    units = "path string, pid int, packet_index long, pts long, packets long, signature string"
    donor = spark.createDataFrame([("d", 9, 10 * i, 3600 * i, 10, f"s{i}") for i in range(30)], units)
    hurt = spark.createDataFrame([(1, 0, "s3", "s4", "s10", "s11", 3600 * 7)], "pid int, region_id long, before1 string, before2 string, after1 string, after2 string, duration long")
    assert [(r.start_packet, r.end_packet) for r in anchors.region_candidates(donor, donor, hurt).collect()] == [(40, 100)]
    h = "path string, pid int, h long"
    same = anchors.identified(spark.createDataFrame([("r", 1, i) for i in range(20)], h), spark.createDataFrame([("d", 9, i) for i in range(4, 30)] + [("d", 8, 1)], h)).collect()
    assert [(r.pid, r.donor_pid, r.hits) for r in same] == [(1, 9, 16)]
    rows = spark.createDataFrame([("a", 5, 90_000), ("a", 58, 900_000), ("a", 200, 1_800_000)], "path string, packet_index long, t long")
    times = spark.createDataFrame([("a", 10, 1000.0, 180_000), ("a", 60, 1010.0, 1_080_000)], "path string, packet_index long, utc_seconds double, t long")
    assert [r.utc_seconds for r in anchors.broadcast_times(rows, times).orderBy("packet_index").collect()] == [999.0, 1008.0, 1018.0]


def test_extraction_totals(spark):
    from packetloom.functions import synth

    p = packet.decode(table(spark, [synth.packet(0x100, c, tei=c == 3, tsc=2 if c == 1 else 0) for c in (0, 1, 2, 2, 3, 7)]))
    (r,) = edit.extraction_totals(p, detect.continuity_rows(p), [0x100]).collect()
    assert (r.transport_errors, r.scrambled, r.duplicates, r.anomalies) == (1, 1, 1, 2)
