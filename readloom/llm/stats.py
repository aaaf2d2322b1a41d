"""Statistics of whole texts, which the quality classifier and the quality rules read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import BLANKS, slices

ship(__name__)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "bar_ratio",
    "digit_ratio", "stop_ratio", "same_next_ratio", "distinct_ratio", "words_a_line", "upper_word_ratio", "log_words",
)
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"


def describe(text: str | None) -> tuple[float, ...]:
    """The counts, then the ratios, of one text; null counts as empty and all are 0 then."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = raw.split()
    n = len(w)
    if not n:
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        return (0.0, 0.0, float(symbols), 0.0, 0.0, *([0.0] * len(RATIOS)))
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = text.split("\n")
    seen: set[str] = set()
    dup = filled = 0
    for line in lines:
        if line.strip(BLANKS):
            filled += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, n)
    repeat = 0
    if n >= 3:
        # two steps, so that no product leaves 64 bits
        pair = np.unique(a[:-2] * len(ids) + a[1:-1], return_inverse=True)[1]
        _, inv, cnt = np.unique(pair * len(ids) + a[2:], return_inverse=True, return_counts=True)
        hit = cnt[inv] >= 2
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k:n - 2 + k] |= hit
        repeat = int(cover.sum())
    less = lambda cut: len(raw) - len(raw.translate(None, cut))
    symbols, upper = less(SYMBOLS), less(UPPER)
    lower = less(bytes(range(97, 123)))
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return (
        float(n), float(chars), float(symbols), float(dup), float(repeat),
        chars / n, symbols / chars, dup / filled, repeat / n, upper / max(1, upper + lower), raw.count(b"!") / n,
        raw.count(b"|") / n, less(DIGITS) / chars, ends / n, float((a[1:] == a[:-1]).mean()) if n > 1 else 0.0,
        len(ids) / n, n / filled, sum(x.isupper() and len(x) > 1 for x in w) / n, float(np.log1p(n)),
    )


def described(texts: pa.Array) -> np.ndarray:
    """The counts and ratios of each text, one row a text."""
    return np.array([describe(t) for t in texts.to_pylist()], float).reshape(-1, len(COUNTS) + len(RATIOS))


def stat_columns(got: np.ndarray, prefix: str = "") -> tuple[list[pa.Array], list[str]]:
    names = [*COUNTS, *RATIOS]
    return [pa.array(got[:, i].astype(np.int64) if c in COUNTS else got[:, i]) for i, c in enumerate(names)], [prefix + c for c in names]


STAT_SCHEMA = [f"{c} {'long' if c in COUNTS else 'double'}" for c in (*COUNTS, *RATIOS)]


def with_stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a row: the id as `doc_id`, the counts as long, the ratios as double.

    No shuffle: Python sees batches of (id, text) and hands back numbers only.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols, names = stat_columns(described(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *STAT_SCHEMA]))


def add_stats(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """All columns of the table, then the statistics with a prefix to their names; each text is sent once."""
    from pyspark.sql import types as T

    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema, *(T.StructField(prefix + x.split(" ")[0], T.LongType() if x.endswith("long") else T.DoubleType()) for x in STAT_SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols, names = stat_columns(described(b.column(at)), prefix)
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 when divided by 5: rows that no model learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `max_rows` labelled documents that aren't held out.

    The bound holds for ids before any text is read, so the broadcast side has at
    most `max_rows` rows and no text is shuffled or collected. Rows are taken in
    the order of a hash of the id; a document with several labels counts once,
    with the smallest; rows without label or id don't count.
    """
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~is_held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    picked = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left_semi")
    rows = with_stats(picked, id_col, text_col).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id")
    got = rows.orderBy(F.xxhash64("doc_id"), *[c for c in rows.columns]).limit(max_rows).toPandas()
    return got[[*COUNTS, *RATIOS]].to_numpy(float), (got["_y"].to_numpy() > 0).astype(float)
