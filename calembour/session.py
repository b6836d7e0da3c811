"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of ours gets; a caller's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.driver.maxResultSize": "8g",
}


def build_session(cores: int | str = "*", app: str = "calembour", driver_memory: str = "16g", **extra: str) -> SparkSession:
    """A local session; ``extra`` maps option names, with ``__`` for dots, to values."""
    options = {**DEFAULTS, "spark.driver.memory": driver_memory, **{k.replace("__", "."): str(v) for k, v in extra.items()}}
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=options).getOrCreate()


@contextmanager
def session_scope(**kwargs):
    """Yield a session and stop it afterwards, but only when this call started it."""
    running = SparkSession.getActiveSession()
    spark = running or build_session(**kwargs)
    try:
        yield spark
    finally:
        if running is None:
            spark.stop()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where neither the setting nor an earlier call chose a folder, and everything
    runs on one machine (tests, a laptop), a temporary one is made.
    """
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="calembour-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


class Scratch:
    """Intermediate tables of one long job, as compressed files in the shared checkpoint folder.

    They take a fraction of a checkpoint's disk, and each goes as soon as it is dropped; at
    the end of the ``with`` block all are gone, so what is returned must be checkpointed.
    The shuffle files behind a table go once it is written: Spark removes them when the
    driver's garbage is collected, which by itself happens long after the disk is full.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.paths.clear()
        self._remove(self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.paths:
                self._remove(self.paths.pop(id(df))[1])

    def _remove(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(Path(package.name) / f.relative_to(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
