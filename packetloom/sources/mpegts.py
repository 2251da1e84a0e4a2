"""``spark.read.format("mpegts")``: packets of transport files, split into aligned byte ranges; and an ordered writer.

Options of the reader: ``on_sync_loss`` (``resync`` finds the next four sync bytes, ``skip`` leaves bad packets out, ``fail`` raises),
``max_bytes`` (prefix of each file), ``split_packets``, ``table`` (``packets``, or ``losses`` for the byte ranges that resync lost). Bounds on ``packet_index``
are pushed into the split plan. Paths without a scheme are local; others open through pyarrow's file systems.

A packet or loss belongs to the split in which it begins, and what is read does not depend on the splits: a split that starts inside a file walks up to its
start from a little before it, from every phase at once, and goes further back until all walks end at one place, as the one from the file's first sync
must then as well. ``packet_index`` is the packet's place on the grid of 188 bytes from the file's first sync; after a loss :func:`reindex`
numbers packets by their order instead.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from packetloom.operators import seq

SIZE, SYNC = 188, 0x47
HEAD_BYTES = 5 << 20
SCHEMA = "path string, packet_index bigint, file_offset bigint, raw binary"
LOSSES = "path string, start bigint, end bigint"
READ_PACKETS = 8192


def find_sync(data: bytes, positions: int = 4, start: int = 0) -> int:
    """First offset with sync bytes there and at the next ``positions`` - 1 packets; -1 if there is none."""
    limit = len(data) - SIZE * (positions - 1)
    at = data.find(SYNC, start)
    while 0 <= at < limit:
        if all(data[at + k * SIZE] == SYNC for k in range(1, positions)):
            return at
        at = data.find(SYNC, at + 1)
    return -1


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, a folder's files or a local glob, in order of name."""
    if "://" not in path and glob.has_magic(path):
        return sorted((p, os.path.getsize(p)) for p in glob.glob(path))
    system, inner = open_fs(path)
    info = system.get_file_info(inner)
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file://") else ""
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File)


@dataclass
class Split(InputPartition):
    path: str
    sync: int
    start: int
    end: int
    size: int


def entry(file, split: Split, back: int = 64) -> int:
    """Where the scan from the file's first sync goes on at or after the split's start."""
    while split.start > split.sync:
        low = max(split.sync, split.start - back * SIZE)
        data = np.frombuffer(file.read_at(min(split.size, split.start + 4 * SIZE) - low, low), np.uint8)
        sync = data == SYNC
        four = np.flatnonzero(sync[: len(sync) - 3 * SIZE] & sync[SIZE : len(sync) - 2 * SIZE] & sync[2 * SIZE : len(sync) - SIZE] & sync[3 * SIZE :]) if len(sync) > 3 * SIZE else np.empty(0, np.int64)
        beyond = len(data) + SIZE  # no resync so far
        after = np.append(four, beyond)
        goal = split.start - low
        walks = np.zeros(1, np.int64) if low == split.sync else np.arange(SIZE)
        while len(walks) and walks[0] < goal:
            go = walks < goal
            at = walks[go]
            walks = np.unique(np.concatenate([np.where(sync[at], at + SIZE, after[np.searchsorted(four, at)]), walks[~go]]))
        if len(walks) == 1:
            if walks[0] < beyond:
                return low + int(walks[0])
            found = _next_sync(file, split.start, split.size)
            return split.size if found < 0 else found
        back *= 8
    return split.start


def parsed(split: Split, on_loss: str) -> Iterator[tuple[str, int, np.ndarray | int]]:
    """("packets", offset of the first, rows of bytes), with ("offsets", 0, their offsets) before it where they do not follow one another, and ("loss", start, end)."""
    system, inner = open_fs(split.path)
    with system.open_input_file(inner) as file:
        at = entry(file, split) if on_loss == "resync" else split.start
        while at < split.end and at + SIZE <= split.size:
            whole = min(READ_PACKETS, -(-(split.end - at) // SIZE), (split.size - at) // SIZE)
            rows = np.frombuffer(file.read_at(whole * SIZE, at), np.uint8)
            whole = len(rows) // SIZE
            if not whole:
                return
            rows = rows[: whole * SIZE].reshape(whole, SIZE)
            good = rows[:, 0] == SYNC
            if good.all():
                yield "packets", at, rows
            elif on_loss == "skip":
                yield "offsets", 0, at + np.flatnonzero(good) * SIZE
                yield "packets", at, rows[good]
            else:
                n = int(good.argmin())
                if n:
                    yield "packets", at, rows[:n]
                at += n * SIZE
                if on_loss == "fail":
                    raise ValueError(f"sync lost at byte {at} of {split.path}")
                found = _next_sync(file, at, split.size)
                end = split.size if found < 0 else found
                yield "loss", at, end
                at = end
                continue
            at += whole * SIZE


def _next_sync(file, at: int, size: int) -> int:
    step = READ_PACKETS * SIZE
    while at < size:
        data = file.read_at(min(step, size - at), at)
        found = find_sync(data)
        if found >= 0:
            return at + found
        if at + len(data) >= size:
            return -1
        at += max(1, len(data) - 3 * SIZE)
    return -1


class PacketReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("packet_index",) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark checks each row as well

    def partitions(self):
        out = []
        step = int(self.options.get("split_packets", 1 << 18)) * SIZE
        for path, size in list_files(self.options["path"]):
            size = min(size, int(self.options.get("max_bytes", size)))
            system, inner = open_fs(path)
            with system.open_input_file(inner) as file:
                sync = find_sync(file.read_at(min(HEAD_BYTES, size), 0))
            if sync < 0:
                if self.options.get("on_sync_loss") == "fail":
                    raise ValueError(f"no sync in {path}")
                continue
            first = sync + self.low * SIZE
            last = size if self.high is None else min(size, sync + self.high * SIZE)
            out += [Split(path, sync, a, min(a + step, last), size) for a in range(first, last, step)]
        return out or [Split("", 0, 0, 0, 0)]

    def read(self, partition: Split):
        if not partition.path:
            return
        losses = self.options.get("table") == "losses"
        offsets = None
        for kind, at, x in parsed(partition, self.options.get("on_sync_loss", "resync")):
            if kind == "loss":
                if losses:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([at], pa.int64()), pa.array([x], pa.int64())], ["path", "start", "end"])
            elif kind == "offsets":
                offsets = x
            elif not losses:
                yield self._batch(partition, at + np.arange(len(x)) * SIZE if offsets is None else offsets, x)
                offsets = None

    def _batch(self, p: Split, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        n = len(rows)
        path = pa.array([p.path]).take(pa.array(np.zeros(n, np.int64)))
        raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * SIZE).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
        return pa.RecordBatch.from_arrays([path, pa.array((at - p.sync) // SIZE, pa.int64()), pa.array(at, pa.int64()), raw], ["path", "packet_index", "file_offset", "raw"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    packets: int


class PacketWriter(DataSourceWriter):
    """Writes each partition to a part file beside the target; the commit joins parts in order and renames the whole."""

    def __init__(self, path: str):
        self.path = path
        self.base = f"{os.path.dirname(path) or '.'}/.{os.path.basename(path)}.{uuid.uuid4().hex}.tmp"

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        name = f"{self.base}.{number:06d}.{context.attemptNumber()}"
        system, inner = open_fs(name)
        n = 0
        with system.open_output_stream(inner) as out:
            for row in iterator:
                out.write(bytes(row.raw))
                n += 1
        return Part(number, name, n)

    def commit(self, messages):
        system, whole = open_fs(self.base)
        with system.open_output_stream(whole) as out:
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                part_system, part = open_fs(m.name)
                with part_system.open_input_stream(part) as src:
                    while data := src.read(1 << 22):
                        out.write(data)
        system.move(whole, open_fs(self.path)[1])
        self._drop(messages)

    def abort(self, messages):
        self._drop(messages)

    def _drop(self, messages):
        for m in messages:
            if m:
                system, inner = open_fs(m.name)
                if system.get_file_info(inner).type == fs.FileType.File:
                    system.delete_file(inner)


class MpegTs(DataSource):
    @classmethod
    def name(cls):
        return "mpegts"

    def schema(self):
        return LOSSES if self.options.get("table") == "losses" else SCHEMA

    def reader(self, schema):
        return PacketReader(dict(self.options))

    def writer(self, schema, overwrite):
        return PacketWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MpegTs)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("mpegts").options(**{k: str(v) for k, v in options.items()}).load(path)


def losses(spark: SparkSession, path: str, **options) -> DataFrame:
    return read(spark, path, table="losses", **options)


def reindex(packets: DataFrame) -> DataFrame:
    """``packet_index`` by order of offset, which after a loss differs from the place on the grid."""
    rows = seq.scan(packets, ["path"], "file_offset", sums={"__n": F.lit(1).cast("long")}, chunk=SIZE << 18)
    return rows.withColumn("packet_index", F.col("__n") - 1).select(*packets.columns)


def write(df: DataFrame, path: str, order: str | list[str] = "packet_index", partitions: int | None = None, overwrite: bool = False) -> None:
    """Writes ``raw`` in order; nothing is left behind if a task fails."""
    order = [order] if isinstance(order, str) else order
    spark = df.sparkSession
    register(spark)
    if "://" not in path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster the target must name a file system that driver and executors share")
    system, inner = open_fs(path)
    if not overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select("raw", *order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.select("raw").write.format("mpegts").mode("append").save(path)
