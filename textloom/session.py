"""Session factory and the few run-time settings the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter makes its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temp folder in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def _own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, which goes when the application ends."""
    if not getattr(spark.sparkContext, "_textloom_folder", False):
        path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.sparkContext._textloom_folder = True
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    for paths in getattr(_open, "scopes", []):
        paths.append(path)
    return out


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What this thread materialises within is deleted at the end, but for the paths that are taken out of the list."""
    scopes = _open.scopes = getattr(_open, "scopes", [])
    paths: list[str] = []
    scopes.append(paths)
    try:
        yield paths
    finally:
        scopes[:] = [x for x in scopes if x is not paths]
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialise`` returned; nothing may read it any more."""
    _delete(df.sparkSession, df._textloom_path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int) -> None:
    """Arrow batches of this session take ``most`` bytes at most until ``forget``; a smaller setting stays. Frames are run
    after the function that made them, so the setting has to outlive it."""
    now = spark.conf.get(_BATCH)
    if now.rstrip("b").isdigit() and int(now.rstrip("b")) > most:
        if getattr(spark.sparkContext, "_textloom_batch", None) is None:
            spark.sparkContext._textloom_batch = now
        spark.conf.set(_BATCH, f"{most}b")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that workers import it by name wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="textloom-pkg-")  # read by the driver only, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "textloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(own):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("textloom", os.path.relpath(full, own)))
    sc.addPyFile(path)
    sc._textloom_shipped = True


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has written in between, and give the session its batch size back; call it
    when no frame is read any more."""
    _delete(spark, _own_dir(spark))
    before = getattr(spark.sparkContext, "_textloom_batch", None)
    if before is not None:
        spark.conf.set(_BATCH, before)
        spark.sparkContext._textloom_batch = None
