"""Cutting long lineages with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary
    folder; on a cluster, where executors wouldn't see the same files, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written as Parquet into the shared folder and read again: lost executors cost no recomputing."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, key=id(out): _PATHS.pop(key, None)), path)
    return out


def as_table(df: DataFrame, name: str = "step") -> DataFrame:
    """df itself where it is a table from cut(), else that of cut()."""
    held = _PATHS.get(id(df))
    return df if held is not None and held[0]() is df else cut(df, name)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of tables from cut() that nothing will read again, on whatever file system they are."""
    for df in frames:
        _, path = _PATHS.pop(id(df))
        session = df.sparkSession
        folder = session._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)
