"""Connected components of a narrow edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, salted_join, ship

HELD = 1 << 20


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges from each node to the smallest node it reaches over the given edges."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            after = root[root]
            if np.array_equal(after, root):
                break
            root = after
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    own = root == np.arange(len(nodes))
    return nodes[~own], nodes[root[~own]]


def forest(edges: DataFrame) -> DataFrame:
    """(a, b) edges with the same components, each partition's contracted to at most one a node (for ``HELD`` edges at a time)."""
    ship(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(0, np.int64),) * 2], 0
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size > HELD:
                held = [_contract(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2:  # a large forest goes on in parts
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["a", "b"])
                    held, size = [(np.zeros(0, np.int64),) * 2], 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _contract(*(np.concatenate(c) for c in zip(*held)))], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _stars(e: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v. Minima combine before the shuffle; the join back is salted."""
    sym = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = salted_join(sym, low, ["u"], F.col("v"), "inner")
    if small:
        out = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))
    else:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; only nodes with an edge are returned."""
    e = cut(forest(edges).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        e = cut(_stars(e, False))
        release(e)
        e = cut(_stars(e, True))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        release(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
