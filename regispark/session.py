"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; sizes and memory are the cluster's business.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "regispark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` (dots as double underscores) overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of one parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session on one machine (local) gets a
    temporary folder; on a cluster other executors could not read that, so it is an error there. A lost executor costs no
    more than re-reading files.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for data that outlives a stage."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="regispark-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def parallelism(df: DataFrame) -> int:
    """Partitions to spread a CPU-bound Python stage over: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, also on machines and in folders that don't hold it; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="regispark-package-")  # read by the driver alone
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "regispark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for below, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(below, n)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
