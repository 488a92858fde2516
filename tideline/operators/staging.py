"""Tables written to the folder that driver and executors share, and read back.

Iterative operators cut their lineage with these, so that a lost executor repeats one step. The
folder is spark.checkpoint.dir; where that is unset, a single process that is driver and
executor at once (tests) gets a temporary one, and a cluster has to name its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest side, in bytes, that an operator broadcasts.
BROADCAST_BYTES = 32 << 20
_staged: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; deleted at the end of the process."""
    path = f"{shared_folder(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    _staged[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back; deleted by release() or at the end of the process."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        spark = _staged.pop(table._staged_at, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            delete(spark, table._staged_at)


@atexit.register
def release_all() -> None:
    for path, spark in list(_staged.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            break
    _staged.clear()
