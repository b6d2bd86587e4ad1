"""Small file operations on whatever file system a path names, done by the driver through Hadoop."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    path: str
    #: By the clock of the file system, in seconds.
    modified: float


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, folder: str) -> list[Entry]:
    """What lies in a folder, by name; nothing if there is no such folder."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    found = [(s.getPath(), s.getModificationTime()) for s in files.listStatus(path)]
    return sorted(Entry(p.getName(), p.toString(), t / 1000) for p, t in found)


def exists(spark: SparkSession, path: str) -> bool:
    path, files = _path(spark, path)
    return files.exists(path)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark job has written the folder to its end."""
    return exists(spark, f"{folder}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    path, files = _path(spark, path)
    files.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file; the folder it goes to is made."""
    path, files = _path(spark, source)
    to, _ = _path(spark, target)
    files.mkdirs(to.getParent())
    if not files.rename(path, to):
        raise OSError(f"{source} can't be moved to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file; readers see all of it or none."""
    hidden = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    target, files = _path(spark, hidden)
    out = files.create(target)
    out.write(bytearray(text.encode()))
    out.close()
    move(spark, hidden, path)


def read_text(spark: SparkSession, path: str) -> str:
    source, files = _path(spark, path)
    stream = files.open(source)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
