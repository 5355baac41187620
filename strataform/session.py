"""Session, shared-storage and packaging helpers used by every operator family."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_strataform_shipped"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITE_CONF = {
    # shuffle files of a write go as soon as it ends
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # fewer rows a batch keep Python workers small
    _BATCH: "2000",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataform")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("STRATAFORM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store it can read works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext.

    Functions run in Python workers import their modules by name, and a cluster's workers
    do not see the driver's folders, so the sources travel as a zip file. Where the session has
    Spark's own number of rows for an Arrow batch, it gets a smaller one, as documents are long.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strataform-")) / "strataform_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where unset on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='strataform-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written_dir(spark: SparkSession) -> str:
    """This application's own folder of written tables."""
    return f"{shared_dir(spark)}/strataform/{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Delete the written tables of this application. DataFrames that read them, results of operators among them, are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Hand memory that this process has freed back to the system."""
    import ctypes
    import gc

    import pyarrow

    gc.collect(0)
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run):
    """A mapInArrow function that hands freed memory back to the system when its partition ends.

    Python workers are reused, and what one partition has freed would otherwise stay with them.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, which cuts its lineage.

    The written table survives the loss of any executor. Shuffle files of the write are
    released as soon as it ends, so peak disk is one step's shuffle and not the sum.
    """
    path = f"{written_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITE_CONF}
    try:
        for k, v in _WRITE_CONF.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
