"""Helpers that the corpus operators share: staged tables, row keys, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator broadcasts.
BROADCAST_BYTES = 32 << 20
#: With this setting Spark drops the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: dict[str, tuple[SparkSession, str | None]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset,
    one process that is driver and executor at once (tests) gets a temporary one; a cluster
    has to name its folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, so that a lost
    executor costs no recomputation of what came before, and gives sizes to the planner.
    by: a column to bucket the table by, so that groups and joins on it shuffle only what
    they meet. The table is deleted by release(), or at the end of the process."""
    spark = df.sparkSession
    key = uuid.uuid4().hex
    path, table = f"{shared_folder(spark)}/tideline/{name}-{key}", None
    if spark.conf.get(_CLEANUP, None) is None:
        spark.conf.set(_CLEANUP, "true")  # for good: queries of one session may run side by side
    if by is None:
        df.write.options(**options).parquet(path)
    else:
        n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tideline_{name}_{key}"
        df.repartition(n, by).write.format("parquet").options(path=path, **options).bucketBy(n, by).saveAsTable(table)
    _staged[path] = spark, table
    made = spark.table(table) if table else spark.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that came from them is staged too."""
    for table in tables:
        _delete(table._staged_at)


def _delete(path: str) -> None:
    spark, table = _staged.pop(path, (None, None))
    if spark is None or spark.sparkContext._jsc is None:
        return
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release_all() -> None:
    """Delete what is still staged: tables that the results of queries are read from. Call it
    between queries of a long session, once their results are written."""
    for path in list(_staged):
        try:
            _delete(path)
        except Exception:  # the session has ended: the folder's owner clears it
            _staged.clear()


def fits_broadcast(rows: int, width: int) -> bool:
    return rows * width <= BROADCAST_BYTES


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n
