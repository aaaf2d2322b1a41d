"""Quality rules: boosted trees over document statistics, with monotone features.

Two counting rules come first (too few words, too much repetition); what passes
them is scored by gradient-boosted trees that learnt `quality` labels. The trees
are flattened to numpy node arrays, so a batch is scored by a few gathers a
level. More symbols, repeated lines, repeated words, shouting or marks can only
lower a score.

Null and empty texts have no words, so they fail the base. Repeated rows are
scored each for itself, ids may be null, and other columns aren't read. With no
labels, or labels of one kind, the score is a constant above the cut and the
base alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm import trees
from readloom.llm.common import slices
from readloom.llm.stats import COUNTS, RATIOS, STAT_SCHEMA, described, labelled_sample, stat_columns

ship(__name__)

FALLING = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "bang_ratio", "bar_ratio", "same_next_ratio", "upper_word_ratio")
INPUTS = list(RATIOS)


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> trees.Trees:
    """Learn from at most `max_rows` labelled rows, never from held-out ones."""
    x, y = labelled_sample(docs, labels, "quality", max_rows)
    x = x[:, len(COUNTS):]
    if 0 < y.sum() < len(y):
        return trees.fit(x, y, monotone={INPUTS.index(c): -1 for c in FALLING})
    return trees.Trees(*(np.zeros(0, int) for _ in range(5)), np.zeros(0), 2.0)


def apply_rules(df: DataFrame, model: trees.Trees, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row a row: doc_id, the counts, base_failed, tree_score and kept. One pass over the texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = described(b.column(1))
            cols, names = stat_columns(got)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols[: len(COUNTS)], pa.array(model.score(got[:, len(COUNTS):]))], names=["doc_id", *names[: len(COUNTS)], "tree_score"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bad = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *STAT_SCHEMA[: len(COUNTS)], "tree_score double"]))
        .withColumn("base_failed", bad)
        .withColumn("kept", ~F.col("base_failed") & (F.col("tree_score") >= cut))
    )
