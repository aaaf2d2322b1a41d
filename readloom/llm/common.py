"""What the corpus operators share: tables in the shared folder, and the parts of a text."""

from __future__ import annotations

import atexit
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from readloom import ship
from readloom.shared import shared_dir

ship(__name__)

#: The white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()

_left: list[tuple[SparkSession, str]] = []


class Scratch:
    """Parquet tables in the shared folder, which cut the lineage.

    They survive a lost executor. `drop` removes one that is no longer read; `tidy`
    removes the rest, at the latest when the Python driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _left.append((spark, self.base))

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._readloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._readloom_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def made() -> int:
    """How many folders there are for `tidy` now."""
    return len(_left)


@atexit.register
def tidy(since: int = 0) -> None:
    """Delete the tables of the operators that began after `made()` said `since`: their results must not be read any more.

    A long session calls it once it has written what it wants to keep.
    """
    while len(_left) > since:
        spark, base = _left.pop()
        try:
            _delete(spark, base)
        except Exception:  # noqa: BLE001 - the session has ended before us
            continue


def once_per_process(key: str, make: Callable[[], Any]) -> Any:
    """A value that each Python worker makes once, whatever number of tasks it runs."""
    store = sys.modules.setdefault("_readloom_store", types.ModuleType("_readloom_store"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


class Sent:
    """A broadcast of any object, whose class the executors needn't be able to import."""

    def __init__(self, spark: SparkSession, thing: Any) -> None:
        self.key, self.raw = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self) -> Any:
        """The object, made once in each Python worker, which holds the last few."""
        held = once_per_process("sent", dict)
        if self.key not in held:
            while len(held) >= 4:
                held.pop(next(iter(held)))
            held[self.key] = cloudpickle.loads(self.raw.value)
        return held[self.key]


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send whole texts to Python in batches of fewer rows, unless the session already says how many."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == usual:
        spark.conf.set(name, str(rows))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: whole texts are long, and Python holds one batch at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ascii_lower(text: str) -> bytes:
    """UTF-8 of the text with A-Z, and nothing else, lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


def words(text: str) -> list[bytes]:
    """The runs of [^\\x20\\x09-\\x0D], as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()
