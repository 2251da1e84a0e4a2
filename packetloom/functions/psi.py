"""Program-specific information: section checks, parsers and builders. Small byte strings, a few per second of stream."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from packetloom.functions import dvbtext, streams

_TABLE = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _TABLE.append(_c)


def crc32(data: bytes) -> int:
    """CRC-32/MPEG-2: not reflected, initial value of all ones; zero over a section with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _TABLE[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def sealed(body: bytes) -> bytes:
    return body + crc32(body).to_bytes(4, "big")


class Assembler:
    """Sections of one PID from its payloads. ``push`` returns the sections that a payload completes."""

    LONGEST, SHORTEST = 4096, 8

    def __init__(self):
        self.buffer = b""
        self.open = False

    def reset(self) -> None:
        """Damage: what is under way is dropped until the next payload that starts a section."""
        self.buffer, self.open = b"", False

    def push(self, payload: bytes, start: bool) -> list[bytes]:
        out: list[bytes] = []
        if start:
            if not payload:
                return out
            pointer = payload[0]
            if pointer + 1 > len(payload):
                self.reset()
                return out
            if self.open:
                self.buffer += payload[1 : 1 + pointer]
                out += self._cut()
            self.buffer, self.open, payload = b"", True, payload[1 + pointer :]
        if self.open:
            self.buffer += payload
            out += self._cut()
        return out

    def _cut(self) -> list[bytes]:
        out = []
        while len(self.buffer) >= 3 and self.buffer[0] != 0xFF:
            n = 3 + (self.buffer[1] & 15) * 256 + self.buffer[2]
            if not self.SHORTEST <= n <= self.LONGEST:
                self.reset()
                return out
            if len(self.buffer) < n:
                return out
            out.append(self.buffer[:n])
            self.buffer = self.buffer[n:]
        if self.buffer and self.buffer[0] == 0xFF:
            self.buffer = b""
            self.open = False
        return out


def parse_pat(s: bytes) -> dict | None:
    if len(s) < 12 or s[0] != 0:
        return None
    programs = {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 4 - 3, 4)}
    programs.pop(0, None)
    return {"tsid": int.from_bytes(s[3:5], "big"), "version": s[5] >> 1 & 31, "programs": programs}


def parse_pmt(s: bytes) -> dict | None:
    if len(s) < 16 or s[0] != 2:
        return None
    end, n = len(s) - 4, int.from_bytes(s[10:12], "big") & 0xFFF
    if 12 + n > end:
        return None
    out = {"program": int.from_bytes(s[3:5], "big"), "version": s[5] >> 1 & 31, "pcr_pid": int.from_bytes(s[8:10], "big") & 0x1FFF, "descriptors": s[12 : 12 + n], "streams": []}
    at = 12 + n
    while at + 5 <= end:
        n = int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF
        if at + 5 + n > end:
            break
        data = s[at + 5 : at + 5 + n]
        kind, supplement, language = streams.resolve(s[at], data)
        out["streams"].append({"pid": int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF, "raw_type": s[at], "type": kind, "supplement": supplement, "language": language, "descriptors": data})
        at += 5 + n
    return out


def service_descriptor(data: bytes) -> tuple[int, str, str] | None:
    """Service type, provider and name of the first service descriptor."""
    for tag, body in streams.descriptors(data):
        if tag == 0x48 and len(body) >= 3 and 2 + body[1] < len(body):
            p = body[1]
            n = body[2 + p]
            return body[0], dvbtext.decode(body[2 : 2 + p]), dvbtext.decode(body[3 + p : 3 + p + n])
    return None


def parse_sdt(s: bytes) -> dict | None:
    if len(s) < 15 or s[0] != 0x42:
        return None
    out = {"tsid": int.from_bytes(s[3:5], "big"), "version": s[5] >> 1 & 31, "onid": int.from_bytes(s[8:10], "big"), "services": []}
    at, end = 11, len(s) - 4
    while at + 5 <= end:
        n = int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF
        if at + 5 + n > end:
            break
        data = s[at + 5 : at + 5 + n]
        kind, provider, name = service_descriptor(data) or (None, None, None)
        out["services"].append({
            "service_id": int.from_bytes(s[at : at + 2], "big"), "eit_schedule": bool(s[at + 2] & 2), "eit_pf": bool(s[at + 2] & 1), "running_status": s[at + 3] >> 5,
            "free_ca": bool(s[at + 3] & 16), "service_type": kind, "provider": provider, "name": name, "descriptors": data,
        })
        at += 5 + n
    return out


def parse_time(s: bytes) -> datetime | None:
    """UTC of a TDT (no checksum, exactly five bytes) or a TOT (with its checksum)."""
    if len(s) < 8 or s[0] not in (0x70, 0x73):
        return None
    if s[0] == 0x70 and len(s) != 8 or s[0] == 0x73 and (len(s) < 14 or crc32(s)):
        return None
    hms = [(b >> 4) * 10 + (b & 15) for b in s[5:8]]
    if any(b >> 4 > 9 or b & 15 > 9 for b in s[5:8]) or hms[0] > 23 or hms[1] > 59 or hms[2] > 59:
        return None
    return datetime(1858, 11, 17, tzinfo=timezone.utc) + timedelta(days=int.from_bytes(s[3:5], "big"), hours=hms[0], minutes=hms[1], seconds=hms[2])


def _section(table: int, extension: int, version: int, body: bytes, syntax: int = 0xB0) -> bytes:
    n = 5 + len(body) + 4
    if n > 1021:
        raise ValueError("a section of more than 1021 bytes")
    return sealed(bytes([table, syntax | n >> 8, n & 255]) + extension.to_bytes(2, "big") + bytes([0xC1 | (version & 31) << 1, 0, 0]) + body)


def build_pat(tsid: int, version: int, programs: dict[int, int]) -> bytes:
    return _section(0, tsid, version, b"".join(p.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for p, pid in programs.items()))


def build_pmt(program: int, version: int, pcr_pid: int, entries: list[tuple[int, int, bytes]], data: bytes = b"") -> bytes:
    """``entries``: (stream type, PID, descriptors)."""
    body = (0xE000 | pcr_pid).to_bytes(2, "big") + (0xF000 | len(data)).to_bytes(2, "big") + data
    for kind, pid, d in entries:
        body += bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d
    return _section(2, program, version, body)


def build_sdt(tsid: int, version: int, onid: int, services: list[tuple[int, int, bytes]]) -> bytes:
    """``services``: (service id, flags: schedule 2 + present 1 + running status << 4 + free CA 8, descriptors)."""
    body = onid.to_bytes(2, "big") + b"\xff"
    for sid, flags, d in services:
        body += sid.to_bytes(2, "big") + bytes([0xFC | flags & 3, (flags >> 4 & 7) << 5 | (flags >> 3 & 1) << 4 | len(d) >> 8, len(d) & 255]) + d
    return _section(0x42, tsid, version, body, 0xF0)


def build_service_descriptor(kind: int, provider: str, name: str) -> bytes:
    p, n = dvbtext.encode(provider), dvbtext.encode(name)
    return bytes([0x48, 3 + len(p) + len(n), kind, len(p)]) + p + bytes([len(n)]) + n


def with_language(data: bytes, language: str | None) -> bytes:
    """Descriptors whose language descriptor is replaced, appended or (for None) removed; a malformed tail stays."""
    out, at, done = b"", 0, language is None
    for tag, body in streams.descriptors(data):
        whole = data[at : at + 2 + len(body)]
        at += len(whole)
        if tag != 0x0A:
            out += whole
        elif not done:
            code = language.encode("latin-1")[:3].ljust(3)
            out += bytes([tag, max(4, len(body))]) + code + (body[3:4] or b"\0") + body[4:]
            done = True
    if not done:
        out += b"\x0a\x04" + language.encode("latin-1")[:3].ljust(3) + b"\0"
    return out + data[at:]


def with_service(data: bytes, provider: str, name: str) -> bytes:
    """Descriptors with the service descriptor rewritten; the others and a malformed tail stay."""
    out, at = b"", 0
    for tag, body in streams.descriptors(data):
        whole = data[at : at + 2 + len(body)]
        at += len(whole)
        out += build_service_descriptor(body[0] if body else 1, provider, name) if tag == 0x48 else whole
    return out + data[at:]


def eit_for(s: bytes, tsid: int | None = None, service: int | None = None) -> bool:
    """Whether a section is an event table of a stream, and of a service."""
    return len(s) >= 14 and (s[0] == 0x4E or 0x50 <= s[0] <= 0x5F) and tsid in (None, int.from_bytes(s[8:10], "big")) and service in (None, int.from_bytes(s[3:5], "big"))


def eit_renumbered(s: bytes, service: int) -> bytes | None:
    """An event table for another service id; null if its checksum is wrong."""
    return None if crc32(s) else sealed(s[:3] + service.to_bytes(2, "big") + s[5:-4])


def packetize(section: bytes, pid: int, cc: int) -> list[bytes]:
    """Packets of one section: pointer 0, counters from ``cc`` on, stuffed with 0xFF."""
    data, out = b"\0" + section, []
    for i in range(0, len(data), 184):
        head = 0x47000000 | (0x400000 if i == 0 else 0) | pid << 8 | 0x10 | (cc + i // 184) & 15
        out.append(head.to_bytes(4, "big") + data[i : i + 184].ljust(184, b"\xff"))
    return out


RESERVED_PIDS = frozenset((*range(0x20), 0x1FFB, 0x1FFF))


def allocate_pid(used: set[int]) -> int:
    """The lowest free PID from 0x0100 to 0x1FFE."""
    return next(p for p in range(0x0100, 0x1FFF) if p not in used and p not in RESERVED_PIDS)


def check_output_pid(pid: int, used: set[int]) -> int:
    if not 0x20 <= pid <= 0x1FFE or pid in RESERVED_PIDS:
        raise ValueError(f"PID 0x{pid:04X} is reserved")
    if pid in used:
        raise ValueError(f"PID 0x{pid:04X} is used twice")
    used.add(pid)
    return pid
