"""Shared space: tables and files that outlive the executor that wrote them."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all executors are threads of this process, as in tests, a folder of this machine is taken and
    named there; a cluster without a shared folder is an error, as executors would write where the driver cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            spark = table.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _files(spark: SparkSession, path: str) -> list:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of the files of a folder."""
    return sum(f.getLen() for f in _files(spark, path))


def version(spark: SparkSession, path: str) -> str:
    """What tells one state of a file or folder from another: number, bytes and last change of its files."""
    files = _files(spark, path)
    return f"{len(files)}-{sum(f.getLen() for f in files)}-{max((f.getModificationTime() for f in files), default=0)}"


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
