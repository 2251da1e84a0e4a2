"""Stream types: vocabulary, resolution through descriptors, elementary kinds and file suffixes."""

from __future__ import annotations

# Stream types by code: fixed values.
NAMES = {
    0x01: "Mpeg1Video", 0x02: "Mpeg2Video", 0x03: "Mpeg1Audio", 0x04: "Mpeg2Audio", 0x05: "PrivateSection", 0x06: "PrivateData", 0x0F: "Aac", 0x10: "Mpeg4Video",
    0x11: "AacLatm", 0x12: "Mpeg4Systems", 0x13: "Mpeg4SystemsSection", 0x15: "Metadata", 0x1B: "H264", 0x1C: "Mpeg4Audio", 0x20: "Mvc", 0x21: "Jpeg2000", 0x24: "Hevc",
    0x32: "JpegXs", 0x33: "Vvc", 0x36: "Lcevc", 0x42: "Cavs", 0x80: "BluRayPcm", 0x81: "Ac3", 0x82: "Dts", 0x83: "TrueHd", 0x84: "Eac3", 0x85: "DtsHd", 0x86: "DtsHdMaster",
    0x87: "Eac3Atsc", 0x90: "HdmvPgsSubtitle", 0x92: "HdmvTextSubtitle", 0xA1: "Eac3Secondary", 0xA2: "DtsExpressSecondary", 0xD1: "Dirac", 0xD2: "Avs2", 0xD4: "Avs3",
    0xD5: "Av3a", 0xEA: "Vc1",
}
CODES = {n: c for c, n in NAMES.items()}
VIDEO = frozenset(CODES[n] for n in "Mpeg1Video Mpeg2Video Mpeg4Video H264 Mvc Jpeg2000 Hevc JpegXs Vvc Lcevc Cavs Dirac Avs2 Avs3 Vc1".split())
AUDIO = frozenset(CODES[n] for n in "Mpeg1Audio Mpeg2Audio Aac AacLatm Mpeg4Audio BluRayPcm Ac3 Dts TrueHd Eac3 DtsHd DtsHdMaster Eac3Atsc Eac3Secondary DtsExpressSecondary Av3a".split())
AUDIO_SUPPLEMENTS = frozenset(("Ac4", "Opus", "Smpte302M", "Dra"))
# What registration descriptors and descriptor tags stand for: fixed values.
REGISTERED = {b"AC-3": "Ac3", b"EAC3": "Eac3", b"DTS1": "Dts", b"DTS2": "Dts", b"DTS3": "Dts", b"HEVC": "Hevc", b"VVC ": "Vvc", b"VC-1": "Vc1", b"drac": "Dirac"}
REGISTERED_SUPPLEMENTS = {b"AC-4": "Ac4", b"Opus": "Opus", b"BSSD": "Smpte302M", b"DRA1": "Dra", b"KLVA": "SmpteKlv", b"VANC": "Smpte2038", b"ID3 ": "TimedId3"}
TAGGED = {0x6A: "Ac3", 0x7A: "Eac3Atsc", 0x7B: "Dts", 0x7C: "Aac"}
# File suffixes of elementary streams: fixed values.
SUFFIXES = {
    "Mpeg1Video": ".m1v", "Mpeg2Video": ".m2v", "Mpeg1Audio": ".mp1", "Mpeg2Audio": ".mp2", "Aac": ".aac", "Mpeg4Video": ".m4v", "AacLatm": ".latm", "H264": ".h264",
    "Mpeg4Audio": ".aac", "Mvc": ".h264", "Hevc": ".h265", "Vvc": ".h266", "Cavs": ".avs", "Ac3": ".ac3", "Dts": ".dts", "TrueHd": ".thd", "Eac3": ".eac3",
    "Eac3Atsc": ".eac3", "Eac3Secondary": ".eac3", "DtsHd": ".dtshd", "Dirac": ".drc", "Avs2": ".avs2", "Avs3": ".avs3", "Av3a": ".av3a", "Vc1": ".vc1",
}
SUPPLEMENT_SUFFIXES = {"Ac4": ".ac4", "Opus": ".opus", "Smpte302M": ".s302m", "Dra": ".dra", "SmpteKlv": ".klv", "TimedId3": ".id3"}
LAYER_SUFFIXES = {"LayerI": ".mp1", "LayerII": ".mp2", "LayerIII": ".mp3"}
# Kinds of elementary streams that repair treats alike: fixed values.
KINDS = {
    "Mpeg1Audio": "MpegAudio", "Mpeg2Audio": "MpegAudio", "Aac": "AacAdts", "AacLatm": "AacLatm", "Av3a": "Av3a", "Mpeg1Video": "MpegVideo", "Mpeg2Video": "MpegVideo",
    "Cavs": "Cavs", "Avs2": "Avs2", "Avs3": "Avs3", "H264": "H264", "Hevc": "H265",
}


def name_of(code: int) -> str:
    return NAMES.get(code, f"0x{code:02X}")


def is_video(code: int) -> bool:
    return code in VIDEO


def is_audio(code: int, supplement: str | None = None) -> bool:
    return code in AUDIO or supplement in AUDIO_SUPPLEMENTS


def kind_of(code: int, supplement: str | None = None) -> str:
    return KINDS.get(NAMES.get(code, "")) or ("Audio" if is_audio(code, supplement) else "None")


def suffix_of(code: int, layer: str | None = None, supplement: str | None = None) -> str:
    if layer is not None:
        return LAYER_SUFFIXES.get(layer, ".bin")
    return SUPPLEMENT_SUFFIXES.get(supplement, ".bin") if supplement is not None else SUFFIXES.get(NAMES.get(code, ""), ".bin")


def descriptors(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, body) pairs up to the first malformed one."""
    out, at = [], 0
    while at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
        out.append((data[at], data[at + 2 : at + 2 + data[at + 1]]))
        at += 2 + data[at + 1]
    return out


def languages(body: bytes, entry: int) -> str | None:
    found = [body[i : i + 3].decode("latin-1") for i in range(0, len(body) - entry + 1, entry)]
    return ", ".join(found) or None


def resolve(code: int, data: bytes) -> tuple[int, str | None, str | None]:
    """Stream type, supplement and language that a PMT entry and its descriptors stand for; later descriptors win."""
    kind, supplement, language, component, service = code, None, None, None, None
    for tag, body in descriptors(data):
        if tag == 0x05 and len(body) >= 4:
            kind = CODES[REGISTERED[body[:4]]] if body[:4] in REGISTERED else kind
            supplement = REGISTERED_SUPPLEMENTS.get(body[:4], supplement)
        elif tag in TAGGED:
            kind = CODES[TAGGED[tag]]
        elif tag in (0x59, 0x56):
            supplement, language = ("DvbSubtitle", languages(body, 8)) if tag == 0x59 else ("DvbTeletext", languages(body, 5))
        elif tag == 0xFD and len(body) >= 2:
            service = int.from_bytes(body[:2], "big")
        elif tag == 0x52 and body:
            component = body[0]
        elif tag == 0x0A and not language:
            language = languages(body, 4)
    if code == 0x06 and (service == 0x0008 and component in range(0x30, 0x38) or service == 0x0012 and component == 0x87):
        supplement = "AribCaption"
    return kind, supplement, language
