"""Quality classifier: a sparse ensemble of rules read off boosted trees.

Trees are grown on statistics of labelled texts; every path from a root to a
node becomes a rule, a conjunction of comparisons. A lasso on the logistic loss
weighs the rules and drops most of them. The remaining ones are compiled into
one Spark column expression, so scoring is a projection over the statistics.

Scores depend on the text alone. Null and empty texts have the same (all-zero)
statistics and get the score of those. Repeated rows are scored each for itself;
ids may be null; further columns aren't read. Without labels of both kinds the
score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm import trees
from readloom.llm.stats import COUNTS, RATIOS, add_stats, is_held_out, labelled_sample, with_stats

ship(__name__)

INPUTS = list(RATIOS)


@dataclass
class Rules:
    bias: float
    weights: list[float]
    terms: list[tuple[tuple[int, float, bool], ...]]

    def column(self, prefix: str = "") -> Column:
        """The score as a Spark expression over the statistics' columns."""
        margin = F.lit(float(self.bias))
        for w, term in zip(self.weights, self.terms, strict=True):
            cond = None
            for f, t, below in term:
                one = F.col(prefix + INPUTS[f]) <= t if below else F.col(prefix + INPUTS[f]) > t
                cond = one if cond is None else cond & one
            margin = margin + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the logistic loss; the bias isn't penalised."""
    n, m = r.shape
    step = 4 / max(1e-9, np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ zw + zb))) - y
        nw = zw - step * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = zb - step * e.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, penalty: float = 0.0015) -> Rules:
    """Learn from at most `max_rows` labelled rows that aren't held out."""
    x, y = labelled_sample(docs, labels, "quality", max_rows)
    x = x[:, len(COUNTS):]
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(p / (1 - p))), [], [])
    grown = trees.fit(x, y, trees=40, depth=3, rate=0.3, rows=0.7, least=max(5, len(y) // 400))
    terms = trees.paths(grown)
    hits = np.stack([np.logical_and.reduce([(x[:, f] <= t) if below else (x[:, f] > t) for f, t, below in term]) for term in terms], 1).astype(float)
    _, first = np.unique(hits, axis=1, return_index=True)
    first = np.sort(first)
    b, w = _lasso(hits[:, first], y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(b, [float(w[i]) for i in kept], [terms[first[i]] for i in kept])


def score_quality(df: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row a row: doc_id, held_out, score and predicted, then the statistics."""
    out = with_stats(df, id_col, text_col).withColumn("score", rules.column())
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *COUNTS, *RATIOS)


def accepted(df: DataFrame, rules: Rules, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score is at least `cut`."""
    return add_stats(df, text_col, "_stat_").where(rules.column("_stat_") >= cut).select(*(F.col(f"`{c}`") for c in df.columns))
