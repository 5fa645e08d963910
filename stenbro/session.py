"""Session helpers: a local session for tests and benches, table access, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "stenbro") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings a session of their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.stenbro.spread", str(cpus))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over `spark.stenbro.spread` partitions by a hash of `keys` before per-row work that is heavy in Python.

    Off where the setting is absent, whatever the input's size: the scan's own splits are the tasks then. A caller whose
    tables are single row groups, as in a bench on one machine, sets it.
    """
    parts = df.sparkSession.conf.get("spark.stenbro.spread", None)
    return df.repartition(int(parts), *keys) if parts else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that `spark.checkpoint.dir` names.

    Only a session of one machine may leave it unset and gets a folder of its own; on a cluster that is an error, as its
    executors share no such folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stenbro-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/stenbro-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder; it is deleted when the session's JVM ends.

    Against a checkpoint it is compressed, read by column, and keeps its size as a statistic for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
