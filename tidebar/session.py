"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
#: Folders of this process that the JVM deletes when it ends.
_kept: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidebar")
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent a local master gets a folder of its own; any other raises, since its executors would
    write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="tidebar-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage for good.

    Unlike a local checkpoint the table survives the loss of executors. Void columns are kept as strings. The tables of
    an application are deleted when its driver ends; ``drop_table`` deletes one before.
    """
    spark = df.sparkSession
    home = f"{work_dir(spark)}/{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    voids = {c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"}
    (df.withColumns(voids) if voids else df).write.parquet(path)
    if home not in _kept:
        _kept.add(home)
        fs, at = _files(spark, home)
        fs.deleteOnExit(at)
    out = spark.read.parquet(path)
    out._written = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table of ``materialize`` that no later plan reads; None is passed over."""
    if df is not None:
        fs, at = _files(df.sparkSession, df._written)
        fs.delete(at, True)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package as bytes; workers read it with ``pickle.loads(shared.value)``.

    Only for objects whose size a parameter bounds.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))
