"""Audio frame headers: lengths, and a tracker that trusts a header only once the next one stands where it says."""

from __future__ import annotations

# Bit rates in kb/s by (MPEG-1, layer) and sample rates by version: fixed values.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mpeg_header(b: bytes) -> tuple[int, int] | None:
    """(layer, frame bytes) of an MPEG audio header."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, sample = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < rate < 15 or sample == 3:
        return None
    bits, hz, pad = RATES[version == 3, layer][rate - 1] * 1000, SAMPLES[version][sample], b[2] >> 1 & 1
    n = (12 * bits // hz + pad) * 4 if layer == 1 else (72 if layer == 3 and version != 3 else 144) * bits // hz + pad
    return (layer, n) if n >= 4 else None


def adts_length(b: bytes) -> int | None:
    """Frame bytes of an ADTS header: sync, layer 0, a sampling index that is not the forbidden 15, and room for the header (with checksum nine bytes)."""
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xF6 != 0xF0 or b[2] >> 2 & 15 == 15:
        return None
    n = (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5
    return n if n >= (7 if b[1] & 1 else 9) else None


def latm_length(b: bytes) -> int | None:
    """Frame bytes of a LATM header; frames of less than seven are none."""
    n = ((b[1] & 0x1F) << 8 | b[2]) + 3 if len(b) >= 3 and b[0] == 0x56 and b[1] & 0xE0 == 0xE0 else 0
    return n if n >= 7 else None


def frame_length(kind: str, b: bytes) -> int | None:
    if kind == "MpegAudio":
        h = mpeg_header(b)
        return h[1] if h else None
    return adts_length(b) if kind == "AacAdts" else latm_length(b) if kind == "AacLatm" else None


def frames(kind: str, data: bytes, start: int = 0) -> list[tuple[int, int]]:
    """(offset, length) of the frames of a stretch: after damage, two headers in a row confirm the alignment."""
    out, at, sure = [], start, False
    while at < len(data):
        n = frame_length(kind, data[at : at + 6])
        if n and (sure or at + n >= len(data) or frame_length(kind, data[at + n : at + n + 6])):
            if at + n > len(data):
                break
            out.append((at, n))
            at, sure = at + n, True
        else:
            at, sure = at + 1, False
    return out


def probe_layer(data: bytes, limit: int = 65_536) -> str | None:
    """The layer of the first valid header in the first 64 KiB."""
    for i in range(min(len(data), limit) - 3):
        if data[i] == 0xFF and (h := mpeg_header(data[i : i + 4])):
            return ("LayerI", "LayerII", "LayerIII")[h[0] - 1]
    return None


def discriminating(b: bytes) -> bool:
    """Whether a stretch can serve as an anchor: at least 8 distinct bytes, none in more than 7 of 8 places."""
    return len(set(b)) >= 8 and max(b.count(x) for x in set(b)) * 8 <= len(b) * 7
