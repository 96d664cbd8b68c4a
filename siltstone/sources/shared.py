"""The folder that all executors share, and results kept in it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: Folders of kept results that haven't been removed, by application.
_folders: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own on a local master; elsewhere that is an error, as
    executors on other machines wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies; nothing happens if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, kind: str = "kept") -> str:
    """A path in the shared folder that is free and that release() will remove."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """rows, written to the shared folder and read again: lineage is cut, and a lost executor loses nothing.

    before, a kept table of an earlier round that nothing else reads, is removed once rows are written. Column names of rows
    must differ.
    """
    spark = rows.sparkSession
    path = new_folder(spark)
    rows.write.parquet(path)
    if before is not None and (old := getattr(before, "_kept_at", None)):
        remove(spark, old)
        with suppress(ValueError):
            _folders[spark.sparkContext.applicationId].remove(old)
    out = spark.read.schema(rows.schema).parquet(path)
    out._kept_at = path
    return out


def mark(spark: SparkSession) -> int:
    """How many folders are kept now, for release()."""
    return len(_folders.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove what was kept since the mark; frames that read it can't be used afterwards."""
    held = _folders.get(spark.sparkContext.applicationId, [])
    for path in held[since:]:
        remove(spark, path)
    del held[since:]
