"""Session and shared-scratch helpers used by every layer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only where the setting is absent (a local session, as in the tests) a folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    cached = getattr(spark.sparkContext, "_packetloom_scratch", None)
    if cached is None:
        cached = "file://" + tempfile.mkdtemp(prefix="packetloom-")
        spark.sparkContext._packetloom_scratch = cached
    return cached


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, by a name that programs outside Spark open too: it has a scheme, and mounts are followed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/packetloom-{label}-{uuid.uuid4().hex[:12]}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    uri = fs.resolvePath(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


class Scratch:
    """Names tables in the shared folder; each is removed at the latest when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/packetloom-{label}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        self._n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._packetloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that :meth:`keep` wrote and nothing reads any more."""
        path = getattr(df, "_packetloom_path", None)
        if path:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
