"""Lineage cuts that survive a lost executor: tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; only where none is set (tests), one of this machine's own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="karst-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return it read back, without its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/karst/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._karst_path = path
    return back


def release(*staged: DataFrame) -> None:
    """Delete staged tables that no later job reads."""
    for df in staged:
        path = getattr(df, "_karst_path", None)
        if path and path in _left:
            _delete(path, _left.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_left.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(path, spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
    _left.clear()


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
