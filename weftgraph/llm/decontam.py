"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search. Items and documents are sets of word
shingles. Items are partitioned by the number of their shingles (powers of two), as a sketch that serves for
one size is too small or too large for another. An item's sketch holds its smallest hashes,
``m - ceil(CONTAIN * m) + 1`` of its m, so a document that contains the share ``CONTAIN`` of an
item contains part of its sketch for certain (sketches of one fixed size would only find it with some
probability). A partition's bound is the largest hash in its sketches; a document is sketched
for a partition by its hashes up to that bound, and a shared hash makes the pair a candidate,
which is verified by exact shingle containment.

The items are the query set and are broadcast in blocks of at most ``BLOCK`` words in
expectation, some 30 bytes a word; documents are scanned once a block and never shuffled. ``matches`` keeps
each block's rows in a checkpoint before the next is broadcast, so one block is held at a time.
``drop_contaminated`` chains its blocks in one pass: what the workers hold grows with the benchmark
(not with the documents).

Edge cases: an item of fewer words than a shingle is one shingle, its whole word sequence,
and then looked for among windows of that many words; items and texts without words (null,
empty) match nothing; texts of any length are searched whole; repeated documents match each, and null
ids match like others; ids of any type are kept; empty tables give empty results; extra columns are
ignored by ``matches`` and kept by ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textops as X
from .common import cut, ship

WIDTH, CONTAIN = 5, 0.5
BLOCK = 1_000_000


@dataclass
class Part:
    """The items of one shingle width and size class: sketch hashes to probe, and all shingles with their items to verify."""

    width: int
    bound: np.uint64
    sketch: np.ndarray
    full: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    """A block of items: their sizes and their size partitions."""

    ids: np.ndarray
    sizes: np.ndarray
    parts: list[Part]


def build(items: list[tuple[object, str | None]], width: int = WIDTH, contain: float = CONTAIN) -> Index:
    buf, offs = X.raw(pa.array([t or "" for _, t in items], pa.large_string()))
    h, first = X.word_hashes(buf, offs, X.NON_WORD)
    sizes, by = np.zeros(len(items), np.int64), {}
    for i in range(len(items)):
        w = h[first[i] : first[i + 1]]
        if not len(w):
            continue
        k = min(width, len(w))
        s = np.unique(X.shingle_hashes(w, np.array([0, len(w)]), k)[0])
        sizes[i] = len(s)
        sketch = s[: len(s) - math.ceil(contain * len(s) - 1e-9) + 1]  # hashes are uniform: the smallest are a MinHash sketch
        a = by.setdefault((k, len(s).bit_length()), ([], [], []))
        a[0].append(sketch)
        a[1].append(s)
        a[2].append(np.full(len(s), i))
    parts = []
    for (k, _), (a, b, c) in sorted(by.items()):
        full, item, sketch = np.concatenate(b), np.concatenate(c), np.unique(np.concatenate(a))
        order = np.argsort(full, kind="stable")
        parts.append(Part(k, sketch[-1], sketch, full[order], item[order]))
    ids = np.empty(len(items), object)
    ids[:] = [i for i, _ in items]
    return Index(ids, sizes, parts)


def _table(sketch: np.ndarray) -> np.ndarray:
    t = np.zeros(1 << 20, bool)
    t[(sketch >> X.U(44)).astype(np.int64)] = True
    return t


def find(col: pa.Array, index: Index, contain: float = CONTAIN) -> Iterator[tuple[int, int, int]]:
    """(row, item position, shared shingles) for every row of ``col`` that contains an item."""
    tables = [_table(p.sketch) for p in index.parts]
    for i, _, buf, offs in X.blocks(col):
        h, first = X.word_hashes(buf, offs, X.NON_WORD)
        if not len(h):
            continue
        by_width = {k: _windows(h, first, k) for k in {p.width for p in index.parts}}
        for p, table in zip(index.parts, tables):
            s, start = by_width[p.width]
            near = np.flatnonzero(table[(s >> X.U(44)).astype(np.int64)] & (s <= p.bound))
            at = np.minimum(np.searchsorted(p.sketch, s[near]), len(p.sketch) - 1)
            rows = np.unique(np.searchsorted(start, near[p.sketch[at] == s[near]], "right") - 1)
            for r in rows:
                own = np.unique(s[start[r] : start[r + 1]])
                lo, hi = np.searchsorted(p.full, own, "left"), np.searchsorted(p.full, own, "right")
                hits = [p.item[a:b] for a, b in zip(lo, hi) if b > a]
                for x, n in zip(*np.unique(np.concatenate(hits), return_counts=True)) if hits else ():
                    if n >= contain * index.sizes[x] - 1e-9:
                        yield i + int(r), int(x), int(n)


def _windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of exactly ``k`` words; rows with fewer words have none."""
    s, start = X.shingle_hashes(h, first, k)
    short = (np.diff(first) < k) & (np.diff(first) > 0)
    if short.any():
        keep = np.ones(len(s), bool)
        keep[start[:-1][short]] = False
        n = np.diff(start) - short
        s, start = s[keep], np.concatenate([[0], np.cumsum(n)])
    return s, start


def indexes(bench: DataFrame, width: int = WIDTH, contain: float = CONTAIN, block: int = BLOCK) -> Iterator[Index]:
    """The items in blocks; each is small enough to be broadcast."""
    b = bench.select("item_id", "text")
    total = b.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+")))).first()[0] or 0
    n = max(1, math.ceil(total / block))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield build([tuple(r) for r in part.distinct().collect()], width, contain)


def matches(docs: DataFrame, bench: DataFrame, width: int = WIDTH, contain: float = CONTAIN, block: int = BLOCK) -> DataFrame:
    """One row a document and item that it contains: doc_id, item_id, n_shared, containment."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", bench.schema["item_id"].dataType), T.StructField("n_shared", T.LongType()), T.StructField("containment", T.DoubleType())])
    ship(docs)
    kind, out = to_arrow_type(bench.schema["item_id"].dataType), None
    for index in indexes(bench, width, contain, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for b in batches:
                got = list(find(b.column("text"), x, contain))
                ids = b.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.ids[g[1]] for g in got], kind), pa.array([g[2] for g in got], pa.int64()), pa.array([g[2] / float(x.sizes[g[1]]) for g in got], pa.float64())], names=["doc_id", "item_id", "n_shared", "containment"])

        part = cut(docs.select("doc_id", "text").mapInArrow(run, schema))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = WIDTH, contain: float = CONTAIN, block: int = BLOCK) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay, nothing is shuffled."""
    ship(docs)
    for index in indexes(bench, width, contain, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in find(b.column("text"), shared.value, contain)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
