"""The quick check: packets to catalog, events, summaries and report, in one set of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from packetloom.functions import packet
from packetloom.operators import catalog, detect, summary
from packetloom.sources import mpegts


@dataclass
class Check:
    packets: DataFrame
    catalog: catalog.Catalog
    events: DataFrame
    merged: DataFrame
    pids: DataFrame
    pcr: DataFrame

    def bitrate(self) -> DataFrame:
        return summary.bitrate(self.packets, self.pcr, self.catalog)

    def timeline(self, **options) -> DataFrame:
        return summary.timeline(self.packets, self.pcr, self.catalog, **options)

    def candidates(self) -> DataFrame:
        return detect.repair_candidates(self.pcr)

    def verdict(self) -> str:
        return summary.verdict(self.events)

    def report(self) -> str:
        return summary.report(self.pids, self.merged, self.catalog, self.timeline())


def check_packets(packets: DataFrame, features: tuple[str, ...] = detect.FEATURES, losses: DataFrame | None = None) -> Check:
    """``packets``: path, packet_index, file_offset and raw."""
    p = packet.decode(packets)
    c = catalog.build(p)
    events = detect.detect(p, c, features, losses)
    return Check(p, c, events, summary.coalesce(events), summary.pid_summary(p, events, c), detect.clock_rows(p, "pcr_base"))


def check(spark: SparkSession, path: str, features: tuple[str, ...] = detect.FEATURES, **options) -> Check:
    rows = mpegts.read(spark, path, **options)
    lost = mpegts.losses(spark, path, **options) if options.get("on_sync_loss", "resync") == "resync" else None
    return check_packets(mpegts.reindex(rows) if lost is not None else rows, features, lost)
