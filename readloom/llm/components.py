"""Connected components by alternating large-star and small-star steps.

Every step is a minimum by node, pre-aggregated before its shuffle, and a join
that adaptive execution may split, so a node with very many neighbours isn't
gathered anywhere. Before a step each partition ties its own components to
their smallest nodes, a bounded number of edges at a time, which saves rounds.
Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import Scratch

ship(__name__)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def contract(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars around each local component's smallest node, `most` edges at a time."""

    def stars(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate(parts)
        nodes, at = np.unique(edges, return_inverse=True)
        at = at.reshape(edges.shape)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[at[:, 0]], label[at[:, 1]])
            new = label.copy()
            np.minimum.at(new, at[:, 0], low)
            np.minimum.at(new, at[:, 1], low)
            np.minimum.at(new, label, new)
            new = new[new]
            if (new == label).all():
                break
            label = new
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        for i in range(0, len(leaf), 50_000):
            part = leaf[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1))
        n += b.num_rows
        if n >= most:
            yield from stars(held)
            held, n = [], 0
    if n:
        yield from stars(held)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) to (id, component): the smallest id that each node reaches. Only nodes of some edge appear."""
    narrow = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = scratch.keep(narrow.where(F.col("a") != F.col("b")).mapInArrow(contract, "a long, b long"))
    mark = _mark(now)
    while mark[0]:
        # large star: every larger neighbour of u is tied to u's smallest one
        # (written first: a join of two plain tables is one whose hot keys can be split)
        near = now.mapInArrow(contract, "a long, b long")
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m")))
        mid = scratch.keep(both.where(F.col("b") > F.col("a")).join(lows, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).mapInArrow(contract, "a long, b long"))
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = mid.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = mid.join(low, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = scratch.keep(small.where(F.col("a") != F.col("b")).distinct())
        scratch.drop(now, mid, lows)
        now, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
