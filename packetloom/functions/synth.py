"""Packets for fixtures."""

from __future__ import annotations


def timestamp(prefix: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([prefix << 4 | (t >> 30) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def pcr_bytes(base: int, ext: int = 0) -> bytes:
    return ((base & (1 << 33) - 1) << 15 | 0x7E00 | ext).to_bytes(6, "big")


def packet(pid: int, cc: int, payload: bytes | None = None, pusi: bool = False, tei: bool = False, tsc: int = 0, pcr: int | None = None, disc: bool = False, afc: int | None = None, fill: int = 0x55) -> bytes:
    """One packet; shorter payloads are stuffed through the adaptation field, no payload at all fills up with ``fill``."""
    flags = (0x80 if disc else 0) | (0x10 if pcr is not None else 0)
    field = bytes([flags]) + (pcr_bytes(pcr) if pcr is not None else b"") if flags else b""
    room = 184 - (len(field) + 1 if flags else 0)
    if payload is None and afc != 2:
        payload = bytes([fill]) * room
    payload = payload or b""
    if len(payload) < room:
        short = room - len(payload)
        if not flags:
            field = b"" if short == 1 else b"\0" + b"\xff" * (short - 2)
        else:
            field += b"\xff" * short
        flags = flags or 0x100
    kind = afc if afc is not None else (3 if flags else 1) if payload else 2
    head = 0x47000000 | tei << 23 | pusi << 22 | pid << 8 | tsc << 6 | kind << 4 | cc & 15
    out = head.to_bytes(4, "big") + (bytes([len(field)]) + field if flags else b"") + payload
    return out[:188].ljust(188, b"\xff")


def pes(stream_id: int, pts: int | None, body: bytes = b"", dts: int | None = None, length: int = 0) -> bytes:
    stamps = b"" if pts is None else timestamp(2, pts) if dts is None else timestamp(3, pts) + timestamp(1, dts)
    flags = 0 if pts is None else 0x80 if dts is None else 0xC0
    return b"\0\0\1" + bytes([stream_id]) + length.to_bytes(2, "big") + bytes([0x80, flags, len(stamps)]) + stamps + body
