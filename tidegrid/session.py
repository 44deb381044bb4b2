"""Session helpers: local sessions for tests, table loading, and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidegrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent in a local session (tests) a folder of our own is made and set; on a cluster a folder
    of this machine would be another one on each executor, so there the setting must be made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidegrid-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and each later use reads files.

    Losing an executor after this costs a re-read, never a recomputation. The files stay until
    ``release_written``; on a cluster the folder's own retention clears them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidegrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_written(spark: SparkSession) -> int:
    """Delete the files of all ``written`` steps of this driver; returns how many folders went."""
    n = len(_WRITTEN)
    jvm = spark.sparkContext._jvm
    for path in _WRITTEN:
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
        else:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.clear()
    return n


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
