"""Session helpers: table loading and fault-tolerant lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the shared folder of ``spark.checkpoint.dir``, own folder only in local mode.

    A machine-local folder on a real cluster would be unreadable for the other executors, so there the
    missing setting is an error rather than a guess.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pkgloom-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def build_session(app: str = "pkgloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, LAST_WIN map keys)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


class Scratch:
    """Intermediate parquet tables in the shared checkpoint folder, for driver loops that replace a table each round.

    Written tables survive the loss of executors, as checkpoints do, and can be dropped as soon as the next
    round is written. Whatever is left goes when the Python driver ends.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.count = spark, 0
        jvm = spark.sparkContext._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pkgloom-{uuid.uuid4().hex}")
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.root)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """(the table read back, its name for drop)"""
        self.count += 1
        path = f"{self.root.toString()}/t{self.count}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path), path

    def counted(self, df: DataFrame, condition: str = "true") -> tuple[DataFrame, str, int]:
        """As ``write``, with the number of rows that meet ``condition``, counted while they are written."""
        seen = Observation()
        table, path = self.write(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
        return table, path, seen.get["n"]

    def drop(self, path: str) -> None:
        self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


class Folder:
    """Folders on the session's file systems."""

    def __init__(self, spark: SparkSession):
        self.conf, self.path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _at(self, path: str):
        p = self.path(path)
        return p, p.getFileSystem(self.conf)

    def is_file(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def names(self, path: str) -> list[str]:
        """Names in a folder, without those that begin with a dot or an underscore; none if it is missing."""
        p, fs = self._at(path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if n[0] not in "._")

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        """Moves a folder, if there is one, to a place that is free."""
        p, fs = self._at(path)
        target = self.path(to)
        if fs.exists(p):
            fs.mkdirs(target.getParent())
            if not fs.rename(p, target):
                raise OSError(f"{path} could not be moved to {to}")

    def replace(self, df: DataFrame, path: str, partition: str | None = None) -> None:
        """Writes ``df`` beside ``path`` and moves it there when it is whole."""
        p, fs = self._at(path)
        half = f"{p.getParent().toString()}/_{uuid.uuid4().hex}"
        w = df.write.partitionBy(partition) if partition else df.write
        w.parquet(half)
        fs.delete(p, True)
        if not fs.rename(self.path(half), p):
            raise OSError(f"{half} could not be moved to {path}")
