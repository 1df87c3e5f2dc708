"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str = "8", app: str = "ledgerloom") -> SparkSession:
    """A local session as used by the tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; an own one in a local session that names none, an error on a cluster."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "ledgerloom-shared")
    os.makedirs(path, exist_ok=True)
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends in files that survive an executor."""
    path = f"{_cuts(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_removed: set[str] = set()  #: folders that are deleted when the application ends


def removed_at_end(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver ends."""
    if path not in _removed:
        _removed.add(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def _cuts(spark: SparkSession) -> str:
    return removed_at_end(spark, f"{shared_dir(spark).rstrip('/')}/cuts-{spark.sparkContext.applicationId}")


def clear_cuts(spark: SparkSession) -> None:
    """Removes the tables this application has cut; call it when no result built on them is read any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _removed.discard(_cuts(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
