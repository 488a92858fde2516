"""Publishing tables and documents so that readers see all of a version or nothing of it.

Each table is written to a folder of its own through Spark's committer and read back: its count
and hash must be those of what was to be written. Only then is a manifest written that names
all parts, in one rename, and readers go by the newest manifest alone. A run that dies before
leaves folders that nothing names; the version before stays in force. Tables that are not
published again keep their folders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PublishError(RuntimeError):
    """What was written is not what was to be written, or another run was first."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_document(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small document in one piece: written beside its place under a name that no reader
    knows, then renamed, over an older one if replace. Without replace an existing one is an error."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    partial = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.partial")
    out = fs.create(partial, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(partial), fs.makeQualified(target), how)
    except Exception as error:
        fs.delete(partial, False)
        raise PublishError(f"{path} is there already, or can't be written") from error


def read_document(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def summary(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash of them that doesn't depend on their order but counts repeated ones."""
    each = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(each)).first()
    return n, str(total or 0)


def current(spark: SparkSession, root: str) -> dict:
    """The newest manifest: version and, for each table, path, rows and hash."""
    fs, folder = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return {"version": 0, "tables": {}}
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    names = [n for n in names if n.endswith(".json")]
    return json.loads(read_document(spark, f"{root}/manifests/{names[-1]}")) if names else {"version": 0, "tables": {}}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], sources: dict[str, tuple[DataFrame, tuple[int, str]]] | None = None) -> dict:
    """Publishes tables together, as the version after the current one; gives its manifest. sources:
    what the tables were made from, with summary() of each as it was then; a source that has
    changed since stops the publishing. Of two runs at once the second fails."""
    before, made = current(spark, root), {}
    for name, df in tables.items():
        path = f"{root}/{name}/{uuid.uuid4().hex}"
        wanted = summary(df)
        df.write.parquet(path)
        found = summary(spark.read.parquet(path)) if wanted[0] else wanted
        if found != wanted:
            raise PublishError(f"{name}: {found} read back, {wanted} to be written")
        made[name] = {"path": path, "rows": wanted[0], "hash": wanted[1], "schema": df.schema.json()}
    for name, (df, then) in (sources or {}).items():
        if summary(df) != then:
            raise PublishError(f"source {name} has changed")
    manifest = {"version": before["version"] + 1, "tables": before["tables"] | made}
    write_document(spark, f"{root}/manifests/{manifest['version']:010d}.json", json.dumps(manifest, sort_keys=True), replace=False)
    return manifest


def read(spark: SparkSession, root: str, name: str, version: dict | None = None) -> DataFrame:
    """A table as the newest (or a given) manifest has it; its rows must be as many as told there."""
    from pyspark.sql.types import StructType

    entry = (version or current(spark, root))["tables"][name]
    df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])
    if df.count() != entry["rows"]:
        raise PublishError(f"{name}: not the {entry['rows']} rows that its manifest tells")
    return df
