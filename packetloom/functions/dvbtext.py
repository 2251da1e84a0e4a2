"""DVB text: the first byte selects the charset."""

from __future__ import annotations

# ISO 8859 parts by selector byte: fixed values.
PARTS = {0x01: 5, 0x02: 6, 0x03: 7, 0x04: 8, 0x05: 9, 0x06: 10, 0x07: 11, 0x09: 13, 0x0A: 14, 0x0B: 15}


def decode(value: bytes) -> str:
    """Text without control characters; undeclared text is Latin-1, or GB18030 if that yields at least two CJK characters."""
    if not value:
        return ""
    first, charset, skip = value[0], "latin-1", 0
    if first == 0x15:
        charset, skip = "utf-8", 1
    elif first == 0x11:
        charset, skip = "utf-16-be", 1
    elif 0x01 <= first <= 0x0B:
        charset, skip = f"iso8859-{PARTS[first]}" if first in PARTS else charset, 1
    elif first == 0x10 and len(value) >= 3:
        part = value[2] if value[1] == 0 and 1 <= value[2] <= 15 and value[2] != 12 else 0
        charset, skip = f"iso8859-{part}" if part else charset, 3
    body = value[skip:]
    text = body.decode(charset, "replace").strip()
    if skip == 0 and sum(b >= 0x80 for b in body) >= 2:
        other = body.decode("gb18030", "replace").strip()
        if sum("㐀" <= c <= "鿿" for c in other) >= 2:
            text = other
    return "".join(c for c in text if not (ord(c) < 32 or 127 <= ord(c) < 160))


def encode(text: str) -> bytes:
    return b"\x15" + text.encode() if text else b""
