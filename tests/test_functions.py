from datetime import datetime, timezone

import pytest

from packetloom.functions import audio, dvbtext, fields, packet, psi, streams, synth


def test_sections_round_trip_in_pieces():
    assert psi.crc32(b"123456789") == 0x0376E6E7
    pmt = psi.build_pmt(5, 3, 0x101, [(0x1B, 0x101, b""), (0x06, 0x102, b"\x6a\x01\0" + b"\x0a\x04deu\0"), (0x06, 0x103, b"\x05\x04Opus")] * 12)
    assert psi.crc32(pmt) == 0 and len(pmt) > 184
    tool, got = psi.Assembler(), []
    for p in psi.packetize(pmt, 0x1000, 14):
        got += tool.push(p[4:], bool(p[1] & 0x40))
    assert got == [pmt]
    parsed = psi.parse_pmt(pmt)
    assert [(s["type"], s["supplement"], s["language"]) for s in parsed["streams"][:3]] == [(0x1B, None, None), (0x81, None, "deu"), (0x06, "Opus", None)]
    assert psi.parse_pat(psi.build_pat(7, 1, {1: 0x100, 2: 0x200}))["programs"] == {1: 0x100, 2: 0x200}
    with pytest.raises(ValueError):
        psi.build_pmt(1, 0, 0x100, [(0x1B, 0x100, bytes(200))] * 6)


def test_several_sections_in_a_payload_and_damage():
    a, b = psi.build_pat(1, 0, {1: 0x100}), psi.build_pat(1, 1, {1: 0x101})
    tool = psi.Assembler()
    assert tool.push((b"\0" + a + b[:10]).ljust(1), True) == [a]
    assert tool.push(bytes([len(b) - 10]) + b[10:] + a + b"\xff" * 9, True) == [b, a]
    tool.push(b"\0" + a[:5], True)
    tool.reset()
    assert tool.push(a[5:], False) == []


def test_services_times_and_edits():
    d = psi.build_service_descriptor(1, "Prov", "Näme")
    sdt = psi.build_sdt(1, 2, 3, [(10, 1 | 4 << 4, d)])
    s = psi.parse_sdt(sdt)["services"][0]
    assert (s["service_id"], s["provider"], s["name"], s["running_status"], s["eit_pf"], s["free_ca"]) == (10, "Prov", "Näme", 4, True, False)
    assert psi.service_descriptor(psi.with_service(b"\x01\x01x" + d + b"\x48", "P", "N")) == (1, "P", "N") and psi.with_service(d + b"\x48", "P", "N").endswith(b"\x48")
    assert psi.parse_time(b"\x70\x70\x05" + (60_000).to_bytes(2, "big") + b"\x12\x34\x56") == datetime(2023, 2, 25, 12, 34, 56, tzinfo=timezone.utc)
    assert psi.parse_time(b"\x70\x70\x05" + (60_000).to_bytes(2, "big") + b"\x32\x34\x56") is None
    assert psi.with_language(b"\x0a\x04eng\1\x52\x01\x09", "fra") == b"\x0a\x04fra\1\x52\x01\x09" and psi.with_language(b"\x0a\x04eng\1", None) == b""
    eit = psi.sealed(b"\x4e\xb0\x0f\x00\x0a\xc1\0\0\0\1\0\2\0\x4e")
    assert psi.eit_for(eit, 1, 10) and psi.eit_for(psi.eit_renumbered(eit, 11), 1, 11) and psi.eit_renumbered(eit[:-1] + b"x", 1) is None
    assert psi.allocate_pid({0x100, 0x101}) == 0x102


def test_text_charsets():
    assert dvbtext.decode(b"\x15" + "日本".encode()) == "日本" and dvbtext.decode(b"\x01\xb0\xb1") == "АБ" and dvbtext.decode(b"\x10\0\2\xb1") == "ą"
    assert dvbtext.decode("中央电视".encode("gb18030")) == "中央电视" and dvbtext.decode(b"caf\xe9\x86") == "café" and dvbtext.decode(b"") == ""
    assert dvbtext.decode(dvbtext.encode("x")) == "x" and dvbtext.encode("") == b""


def test_stream_vocabulary():
    assert streams.suffix_of(0x1B) == ".h264" and streams.suffix_of(0x24) == ".h265" and streams.suffix_of(3, "LayerII") == ".mp2" and streams.suffix_of(6, None, "Opus") == ".opus"
    assert streams.kind_of(0x24) == "H265" and streams.kind_of(0x81) == "Audio" and streams.kind_of(6) == "None" and streams.is_audio(6, "Ac4")
    assert streams.resolve(0x06, b"\xfd\x02\0\x08\x52\x01\x30")[1] == "AribCaption" and streams.resolve(0x06, b"\x59\x08eng\x10\0\1\0\1") == (6, "DvbSubtitle", "eng")


def test_audio_frames():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # layer III, 128 kb/s, 44.1 kHz
    assert audio.mpeg_header(head) == (3, 417)
    data = b"xx" + (head + bytes(413)) * 3 + head
    assert audio.frames("MpegAudio", data) == [(2, 417), (419, 417), (836, 417)] and audio.probe_layer(data) == "LayerIII"
    adts = bytes([0xFF, 0xF1, 0x50, 0x80, 0x02, 0x1F, 0xFC])
    assert audio.adts_length(adts) == 16 and audio.latm_length(bytes([0x56, 0xE0, 0x10])) == 19
    assert audio.discriminating(bytes(range(16))) and not audio.discriminating(bytes(128))


def test_decoding_and_field_tree(spark):
    raw = synth.packet(0x1AB, 7, synth.pes(0xE0, 2**33 - 5, b"x", dts=12345), pusi=True, pcr=2**32 + 9, disc=True, tsc=2)
    bad = [synth.packet(1, 0)[:100], b"\0" + raw[1:], synth.packet(1, 0, afc=0), b"\x47\0\1\x30\xff" + bytes(183)]
    rows = packet.decode(spark.createDataFrame([("a", i, i * 188, bytearray(r)) for i, r in enumerate([raw, *bad])], "path string, packet_index long, file_offset long, raw binary")).orderBy("packet_index").collect()
    r = rows[0]
    assert (r.pid, r.cc, r.scrambling, r.pusi, r.discontinuity, r.pcr_base, r.pts, r.dts, r.stream_id) == (0x1AB, 7, 2, True, True, 2**32 + 9, 2**33 - 5, 12345, 0xE0)
    assert [x.parse_error for x in rows] == [None, "InvalidSize", "InvalidSyncByte", "ReservedAdaptationControl", "InvalidAdaptationLength"]
    assert not any(x.has_payload for x in rows[1:])
    tree = {x[0]: x for x in fields.tree(raw)}
    assert tree["header/pid"][2] == str(0x1AB) and tree["adaptation/pcr_base"][2] == str(2**32 + 9) and tree["payload/pes/pts_dts_flags"][2] == "3"
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "raw binary")
    assert sorted(len(x.fields) for x in fields.with_tree(df).collect()) == [0, len(fields.tree(raw))]
