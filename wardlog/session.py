"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on: UTC clock and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # The JVM compiles no method above 8000 bytes; wide flag projections must be split, not interpreted.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Base folder that all executors can reach, as named by the cluster.

    Only a local session without the setting gets a folder of its own.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        base = _LOCAL_DIRS.setdefault(app, "") or tempfile.mkdtemp(prefix="wardlog-")
        _LOCAL_DIRS[app] = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lists of the folders staged within the open scopes, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def numbered_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders `name=number` right below a path, by number: batches or versions of a store."""
    if not exists(spark, path):
        return {}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [str(f.getPath()) for f in found if f.isDirectory() and "=" in f.getPath().getName()]
    return {int(name.rsplit("=", 1)[1]): name for name in names}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders staged inside go at the end, but for those staged with `keep`, which belong to the scope around."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove(spark, path)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
