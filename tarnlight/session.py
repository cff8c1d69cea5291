"""Session settings that every entry point shares."""

from __future__ import annotations

import atexit
import functools
import uuid

from pyspark.sql import SparkSession

#: Settings that may be changed on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session that somebody else built."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@functools.lru_cache(maxsize=8)
def _home(root: str, application: str) -> str:
    home = f"{root}/tarnlight-{application}-{uuid.uuid4().hex[:8]}"
    atexit.register(_remove, home)
    return home


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is going down: what is left is only scratch
            return


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp"
    return f"{_home(root.rstrip('/'), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def local_session(cpus: int | str = "*", app: str = "tarnlight", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    for key, value in (base | RUNTIME | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
