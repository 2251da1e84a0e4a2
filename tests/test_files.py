import os

import pytest
from pyspark.sql import functions as F

from packetloom.functions import packet, synth
from packetloom.operators import navigate
from packetloom.sources import files
from tests.test_quick_check import table


def test_files(spark, tmp_path):
    raws = [synth.packet(0x100, i) for i in range(20)]
    for n in ("10.ts", "2.ts", "bad.ts"):
        (tmp_path / n).write_bytes(b"".join(raws) + (b"x" if n == "bad.ts" else b""))
    assert [os.path.basename(p) for p in files.in_order(str(tmp_path))] == ["2.ts", "10.ts", "bad.ts"]
    assert files.validate(f"{tmp_path}/2.ts") == 20
    with pytest.raises(ValueError):
        files.validate(f"{tmp_path}/bad.ts")
    s = files.Snapshot.of([f"{tmp_path}/2.ts"])
    s.check()
    (tmp_path / "2.ts").write_bytes(b"".join(raws[:10]))
    with pytest.raises(ValueError):
        s.check()
    df = table(spark, raws).withColumn("sub_index", F.lit(0))
    assert files.byte_range(df, 188 * 3, 188 * 5 + 1).count() == 3
    parts = df.withColumn("service_id", (F.col("packet_index") % 2).cast("int"))
    out = files.write_services(parts, str(tmp_path))
    assert [open(p, "rb").read() for p in out] == [b"".join(raws[k::2]) for k in (0, 1)]
    with pytest.raises(FileExistsError):
        files.write_services(parts, str(tmp_path))
    es = df.select("path", F.lit(0x101).alias("pid"), "packet_index", F.substring("raw", 5, 100).alias("payload"))
    (p,) = files.write_elementary(es, str(tmp_path), {0x101: (0x0F, None, None)})
    assert p.endswith("0101.aac") and open(p, "rb").read() == b"".join(r[4:104] for r in raws)
    with pytest.raises(ValueError):
        files.write_all({f"{tmp_path}/10.ts": df}, [f"{tmp_path}/10.ts"])


def test_navigation_and_runs(spark):
    raws = [synth.packet(0x100 + i % 2, i // 2, tei=i in (6, 8)) for i in range(40)]
    raws[12] = b"\0" + raws[12][1:]
    p = packet.decode(table(spark, raws))
    assert navigate.same_pid(p, 10, 0x100) == 14 and navigate.same_pid(p, 11, 0x101, False) == 9 and navigate.same_pid(p, 39, 0x100) is None
    assert [r.packet_index for r in navigate.window(p, 5, 3).collect()] == [5, 6, 7]
    (r,) = navigate.damage_runs(p).collect()
    assert (r.start_packet, r.end_packet, r.damaged, r.last_cc, r.missing) == (6, 8, 2, 2, 2)
    si = packet.decode(table(spark, [synth.packet(0x11, c) for c in (0, 1, 1, 3)] + [synth.packet(0x11, 9, disc=True)]))
    assert [(x.pid, x.errors) for x in navigate.si_continuity(si).collect()] == [(0x11, 1)]
    head = bytes([0xFF, 0xFD, 0x90, 0])
    es = spark.createDataFrame([("a", 1, i, bytearray(b"zz" + head + bytes(50))) for i in range(3)], "path string, pid int, packet_index long, payload binary")
    assert [(x.pid, x.layer) for x in navigate.audio_layers(es).collect()] == [(1, "LayerII")]
