"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Only where that is unset and driver and executors
    are one process, as in tests, a temporary folder is set in its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lacuna-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of written tables with a weak reference to what reads each; more than one thread may write.
_written: list[tuple[str, str, object]] = []
_lock = threading.Lock()


def materialize(df: DataFrame, name: str, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The folder lives as long as a DataFrame that reads it, or was derived from one: :func:`sweep` removes it later, and
    at the latest the end of the session does. ``session``: that of the result, if it is another than that of ``df``.
    """
    spark = session or df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    removed_at_exit(spark, path)
    # Plans derived from this one share its relation.
    relation = out._jdf.queryExecution().analyzed().collectLeaves().head().relation()
    with _lock:
        _written.append((spark.sparkContext.applicationId, path, spark.sparkContext._jvm.java.lang.ref.WeakReference(relation)))
    return out


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) in the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def removed_at_exit(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)


def sweep(spark: SparkSession) -> None:
    """Remove the folders of tables that no DataFrame of this session can read any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)  # what Python let go is let go in the JVM a little later
    app = spark.sparkContext.applicationId
    with _lock:
        gone = [path for of, path, reader in _written if of == app and reader.refersTo(None)]
        _written[:] = [x for x in _written if x[0] == app and x[1] not in gone]
    for path in gone:
        fs, at = hadoop(spark, path)
        fs.delete(at, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, for tasks that read or write parts of files."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
