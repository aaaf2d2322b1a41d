"""The folder that driver and executors share, and files in it by Spark's own file systems."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import SparkSession

from readloom import ship

ship(__name__)

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where none is set a temporary one serves a local session, whose executors are
    the driver; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="readloom-"))
    return _made[0]


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


class Piece(NamedTuple):
    """Some bytes of a file."""

    path: str
    start: int
    size: int


def put(spark: SparkSession, path: str, parts: Iterable[bytes | Piece], size: int = 1 << 20) -> int:
    """Write a file under another name and rename it; how many bytes it has. Pieces of files go through the JVM's streams."""
    store, at = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out, held, n = store.create(part, True), bytearray(), 0
    for p in parts:
        if isinstance(p, Piece):
            if held:
                out.write(bytearray(held))
                held.clear()
            whence, there = _at(spark, p.path)
            read = whence.open(there)
            got = spark._jvm.org.apache.commons.io.IOUtils.copyLarge(read, out, p.start, p.size)
            read.close()
            if got != p.size:
                raise OSError(f"{p.path} has {got} bytes from {p.start} on, not {p.size}")
            n += p.size
            continue
        held += p
        n += len(p)
        if len(held) >= size:
            out.write(bytearray(held))
            held.clear()
    if held:
        out.write(bytearray(held))
    out.close()
    store.delete(at, False)
    store.rename(part, at)
    return n


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    store, at = _at(spark, path)
    store.delete(at, True)


def copy(spark: SparkSession, path: str, source: str, start: int = 0) -> None:
    """Write a file of another one's bytes from `start` on, by the JVM's streams."""
    store, at = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    whence, there = _at(spark, source)
    read, out = whence.open(there), store.create(part, True)
    read.seek(start)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, True)  # closes both
    store.delete(at, False)
    store.rename(part, at)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as readers outside of Spark need it."""
    store, at = _at(spark, path)
    full = store.makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full
