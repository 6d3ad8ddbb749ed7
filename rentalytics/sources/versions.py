"""Tables that are replaced as a whole: a version folder, then one pointer swap.

A table at ``path`` holds version folders and a small pointer file that names
the current one and the one before.  A write goes to a new version; only when
that is complete is the pointer replaced, by one rename.  Until then readers
follow the old pointer, so a job that fails midway, or a table that is rebuilt
from itself, leaves the old rows readable.  The version before the current one
stays for readers that have begun on it; the one before that is dropped.

Two writers at once: both versions are whole, the later swap wins.  The rename
is atomic on HDFS-like and local file systems; on object stores without such a
rename the pointer is one small object.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


class _Files:
    """The few file operations needed, on whatever file system ``path`` is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def swap(self, text: str, path: str) -> None:
        """``path`` becomes a file with ``text`` in one rename."""
        staged = f"{path}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(staged), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self.path(staged), self.path(path), options)

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _versions(files: _Files, path: str) -> list[str]:
    """Names of the current version and the one before (empty: no versioned table here)."""
    pointer = f"{path}/{POINTER}"
    return files.read(pointer).split() if files.exists(pointer) else []


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows of the table at ``path``: its current
    version, or ``path`` itself where a plain parquet folder stands."""
    path = path.rstrip("/")
    names = _versions(_Files(spark, path), path)
    return f"{path}/{names[0]}" if names else path


def exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` hold a complete table, versioned or a plain parquet folder?"""
    path = path.rstrip("/")
    files = _Files(spark, path)
    return bool(_versions(files, path)) or files.exists(f"{path}/_SUCCESS")


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Replace the table at ``path`` by what ``write(folder)`` writes into a new folder."""
    path = path.rstrip("/")
    files = _Files(spark, path)
    name = f"v-{uuid.uuid4().hex[:12]}"
    try:
        write(f"{path}/{name}")
    except BaseException:
        files.drop(f"{path}/{name}")
        raise
    old = _versions(files, path)
    files.swap("\n".join([name, *old[:1]]), f"{path}/{POINTER}")
    for gone in old[1:]:
        files.drop(f"{path}/{gone}")
    return path


def replace_catalog_table(df: DataFrame, name: str, save: Callable[[str], None]) -> str:
    """Replace the catalog table ``name``: ``save(staged name)`` writes a table
    beside it, which takes its name when it is whole; the old one goes last.
    A name that the catalog does not know, but whose folder lies in the
    warehouse, is refused, as Spark itself does."""
    spark = df.sparkSession
    known = spark.catalog.tableExists(name)
    staged, old = (f"{name}__{what}_{uuid.uuid4().hex[:8]}" for what in ("new", "old"))
    try:
        save(staged)
        place = spark.sql(f"DESCRIBE TABLE EXTENDED {staged}").where("col_name = 'Location'").first()["data_type"]
        folder = f"{os.path.dirname(place.rstrip('/'))}/{name.split('.')[-1].lower()}"
        if not known and _Files(spark, folder).exists(folder):
            raise FileExistsError(f"{folder} exists, but no table {name}")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    if known:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    return name


def is_path(path_or_name: str) -> bool:
    return "/" in path_or_name or os.path.isabs(path_or_name) or path_or_name.startswith("file:")
