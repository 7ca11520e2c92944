"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables: spark.checkpoint.dir.

    Where a session on one machine has none (tests), a temporary folder is used. On a cluster that would lie on every
    executor's own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'varstrata')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str, ending: str = "") -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}{ending}"
    _written.append((spark, path))
    return path


def give_back(spark: SparkSession) -> None:
    """Returns to the system what the driver's JVM has freed outside of its heap. The hundreds of threads that run jobs,
    broadcasts and requests free into arenas of their own, which otherwise stay as large as they have ever been. JVMs
    without this command (before 17.0.9, or not on Linux) keep it."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    with contextlib.suppress(Py4JError):
        new = spark.sparkContext._gateway.new_array
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = new(jvm.Object, 4)
        for k, x in enumerate((commands, "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0))):
            args[k] = x
        # The server's class isn't open to py4j, its interface is.
        for method in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods():
            if method.getName() == "invoke":
                method.invoke(server, args)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None and spark.sparkContext._jsc is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def made() -> Iterator[list]:
    """The intermediate tables that are written within the block, for discard()."""
    before, out = len(_written), []
    yield out
    out += _written[before:]


def discard(tables: list) -> None:
    """Deletes what made() listed; frames that still read it can't be used afterwards."""
    for one in tables:
        if one in _written:
            _written.remove(one)
            _delete(*one)
    tables.clear()


def drop(stashed: DataFrame) -> None:
    """Deletes a table that stash() gave; no frame that reads it can be used afterwards."""
    for path in {f.rpartition("/")[0] for f in stashed.inputFiles()}:
        _delete(stashed.sparkSession, path)


def release() -> None:
    """Deletes the intermediate tables; frames that still read them can't be used afterwards."""
    while _written:
        _delete(*_written.pop())


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch space
        _written.clear()
