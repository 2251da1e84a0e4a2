"""Around the files: validation, guards against changed sources, natural order, and sinks with several outputs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import streams
from packetloom.sources.mpegts import SIZE, SYNC, list_files, open_fs, write


def natural_key(name: str) -> list:
    """Digit runs as numbers, letters without case; fewer leading zeros first at ties."""
    parts = re.findall(r"[0-9]+|[^0-9]+", name.lower())
    return [[(0, int(p), "") if p[0].isdigit() else (1, 0, p) for p in parts], len(name), name]


def in_order(path: str) -> list[str]:
    return sorted((p for p, _ in list_files(path)), key=natural_key)


def validate(path: str, packets: int = 5) -> int:
    """The number of packets of a file that is whole packets from its first byte on; raises otherwise."""
    system, inner = open_fs(path)
    size = system.get_file_info(inner).size or 0
    if size % SIZE or size < packets * SIZE:
        raise ValueError(f"{path} is not a whole number of at least {packets} packets")
    with system.open_input_file(inner) as f:
        head = f.read_at(packets * SIZE, 0)
    if any(head[i * SIZE] != SYNC for i in range(packets)):
        raise ValueError(f"{path} does not begin with packets")
    return size // SIZE


@dataclass(frozen=True)
class Snapshot:
    """Sizes and times of sources, to be checked again before what was planned from them is written."""

    states: tuple[tuple[str, int, object], ...]

    @staticmethod
    def of(paths: list[str]) -> Snapshot:
        out = []
        for p in paths:
            system, inner = open_fs(p)
            info = system.get_file_info(inner)
            out.append((p, info.size, info.mtime_ns))
        return Snapshot(tuple(out))

    def check(self) -> None:
        for now, was in zip(Snapshot.of([p for p, _, _ in self.states]).states, self.states, strict=True):
            if now != was:
                raise ValueError(f"{now[0]} has changed since it was read")


def byte_range(packets: DataFrame, start: int, end: int) -> DataFrame:
    """Packets that begin in [start, end) of their file."""
    return packets.where((F.col("file_offset") >= start) & (F.col("file_offset") < end))


def write_all(outputs: dict[str, DataFrame], sources: list[str] | None = None, order: list[str] | None = None) -> None:
    """Several files, none of which may exist or be a source: all of them are written or none is left."""
    targets = [open_fs(p)[1] for p in outputs]
    if len(set(targets)) != len(targets) or set(targets) & {open_fs(p)[1] for p in sources or ()}:
        raise ValueError("outputs must differ from one another and from the sources")
    for p in outputs:
        if open_fs(p)[0].get_file_info(open_fs(p)[1]).type != fs.FileType.NotFound:
            raise FileExistsError(p)
    done = []
    try:
        for p, df in outputs.items():
            write(df, p, order or ["packet_index", "sub_index"])
            done.append(p)
    except Exception:
        for p in done:
            open_fs(p)[0].delete_file(open_fs(p)[1])
        raise


def write_services(parts: DataFrame, folder: str) -> list[str]:
    """One file per ``service_id`` of a split."""
    ids = sorted(r["service_id"] for r in parts.select("service_id").distinct().collect())
    out = {f"{folder}/service-{i}.ts": parts.where(F.col("service_id") == i) for i in ids}
    write_all(out)
    return list(out)


def write_elementary(es: DataFrame, folder: str, types: dict[int, tuple[int, str | None, str | None]]) -> list[str]:
    """One file per PID of extracted payloads; ``types`` gives (stream type, audio layer, supplement), which decide the suffix."""
    out = {f"{folder}/{pid:04X}{streams.suffix_of(*kind)}": es.where(F.col("pid") == pid).select(F.col("payload").alias("raw"), "packet_index", F.lit(0).alias("sub_index")) for pid, kind in types.items()}
    write_all(out)
    return list(out)
