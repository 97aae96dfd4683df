"""Shared storage for intermediate tables.

Intermediate results that cut lineage are Parquet tables below the folder that
the cluster names in ``spark.checkpoint.dir``, which driver and executors
share. Only in local mode, where that setting may be absent, is a temporary
folder made; a cluster without it is an error, as each machine would write to
its own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, object] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._conf.get("recordscope.own.checkpoint.dir")
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="recordscope-")
            spark.sparkContext._conf.set("recordscope.own.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    if not _FOLDERS:
        atexit.register(_sweep)
    path = f"{shared_root(spark)}/recordscope/{name}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark.sparkContext._jvm
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._recordscope_folder = path
    return found


def replace(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """materialize(new), which may read old; then old's table is deleted. For loops, whose rounds need their last one only."""
    found = materialize(new, name)
    release(old)
    return found


def replace_counting(old: DataFrame, new: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """replace(), and the number of rows that meet a condition, counted as they are written."""
    seen = Observation()
    found = replace(old, new.observe(seen, F.count(F.when(condition, 1)).alias("n")), name)
    return found, seen.get["n"]


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_recordscope_folder", None)
        if path in _FOLDERS:
            remove(t.sparkSession, path)
            del _FOLDERS[path]


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def _delete(jvm: object, path: str, conf: object) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def remove(spark: SparkSession, path: str) -> None:
    _delete(spark.sparkContext._jvm, path, spark.sparkContext._jsc.hadoopConfiguration())


def clean_up(spark: SparkSession) -> None:
    """Delete every intermediate table that this driver has written; results that read them must have been used."""
    while _FOLDERS:
        remove(spark, _FOLDERS.popitem()[0])


def _sweep() -> None:
    """At the driver's end, what is left."""
    while _FOLDERS:
        path, jvm = _FOLDERS.popitem()
        try:
            _delete(jvm, path, jvm.org.apache.hadoop.conf.Configuration())
        except Exception:  # noqa: BLE001 - the JVM is gone already
            return
