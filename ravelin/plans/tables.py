"""Tables and folders that outlive a stage, in the folder all executors share.

`spark.checkpoint.dir` names that folder. Only where it is unset and all runs in
one process, as in tests, a temporary folder of this process takes its place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Has Spark delete a query's shuffle files when the query ends, and not only when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings to write a large table that is read more than once.
DENSE = {"spark.sql.parquet.compression.codec": "zstd"}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI with its scheme."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ravelin-")
        return _OWN[app]
    if "://" not in named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        named = full if "://" in full else full.replace(":/", ":///", 1)
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder name under the shared one that no other run uses."""
    return f"{shared_dir(spark)}/ravelin/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it the session has these settings."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(df: DataFrame, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns it read back.

    This cuts the lineage as checkpoint() does (a lost executor costs no
    recomputation of what came before) and keeps columns prunable. The shuffle
    files behind it go as soon as it is written. more: settings while it is.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    with settings(spark, {CLEANUP: "true"} | (more or {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables (results of table()) that no later step reads."""
    for t in tables:
        hadoop = t.sparkSession.sparkContext
        path = hadoop._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(hadoop._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes everything that table() and new_dir() have made under this session's folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ravelin")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
