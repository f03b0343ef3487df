"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app_name: str = "dqengine", cores: str = "*", **conf: str) -> SparkSession:
    """A ``local[cores]`` session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is used only when Spark itself runs on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.gettempdir() + "/dqengine-checkpoints"


#: Scratch paths handed out in this process and not released yet.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    path = f"{shared_dir(spark)}/dqengine/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


@contextmanager
def scratch_job(spark: SparkSession) -> Iterator[None]:
    """Frees, at its end, all scratch data written inside it.

    What a job returns must be stored or collected before the end: tables that read scratch
    data are gone afterwards.
    """
    before = len(_scratch)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scratch[before:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        del _scratch[before:]


def release(spark: SparkSession, path: str) -> None:
    """Frees scratch data, a path or what is below one, before its job ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)
    if path in _scratch:
        _scratch.remove(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frees the shuffle files of each query inside it when that query ends.

    Else they stay until the driver collects what refers to them. Tables go on from one query to the next as written ones.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table to the shared folder and go on from there.

    This cuts the lineage, survives the loss of an executor, and lets every later scan read
    only the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
