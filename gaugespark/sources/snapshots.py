"""A table that many writers change: versioned snapshots, each published by one atomic create.

`<path>/_versions/<n>` names the data folder of version n. A writer reads the
latest version, writes its change as a folder of its own, and then publishes it
as the next version by a create that fails if another writer was first; then it
starts again from that one's rows. Readers see whole versions only, and folders
that were never published are never read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Other writers were first, as often as was tried."""


def _paths(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path.rstrip("/"))
    return hadoop, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    hadoop, where, fs = _paths(spark, path)
    folder = hadoop.Path(where, "_versions")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def _read_text(spark: SparkSession, fs, file) -> str:
    stream = fs.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, the latest if none is named; None before the first."""
    hadoop, where, fs = _paths(spark, path)
    known = versions(spark, path)
    if not known:
        return None
    entry = hadoop.Path(hadoop.Path(where, "_versions"), f"{known[-1] if version is None else version:012d}")
    return spark.read.parquet(hadoop.Path(where, _read_text(spark, fs, entry)).toString())


def _published(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Whether this writer's folder has become that version: the entry appears whole, or not at all."""
    hadoop, where, fs = _paths(spark, path)
    entries = hadoop.Path(where, "_versions")
    fs.mkdirs(entries)
    draft, entry = hadoop.Path(entries, f".draft-{uuid.uuid4().hex}"), hadoop.Path(entries, f"{version:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":  # a hard link is the local create that never overwrites
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createLink(local(entry), local(draft))
        else:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(draft, entry, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as error:
        if fs.exists(entry):
            return False
        raise error
    finally:
        fs.delete(draft, False)


def updated(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 10, wait: float = 0.05) -> int:
    """The version that change has become; change gets the latest rows (None for none) and gives all of the next ones.

    change may be called again, on newer rows, so it should do nothing else. A
    folder whose version another writer took is deleted.
    """
    hadoop, where, fs = _paths(spark, path)
    for k in range(tries):
        known = versions(spark, path)
        now = known[-1] if known else 0
        rows = change(snapshot(spark, path, now) if known else None)
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(hadoop.Path(where, folder).toString())
        if _published(spark, path, now + 1, folder):
            return now + 1
        fs.delete(hadoop.Path(where, folder), True)
        time.sleep(wait * (k + 1))
    raise Conflict(f"{path}: {tries} changes met others that were first")


def replaced(new: DataFrame, key: str) -> Callable[[DataFrame | None], DataFrame]:
    """The change that puts new's rows in the place of those of its keys, and leaves the others."""

    def change(rows: DataFrame | None) -> DataFrame:
        if rows is None:
            return new
        return rows.join(new.select(key).distinct(), key, "left_anti").select(rows.columns).unionByName(new)

    return change
