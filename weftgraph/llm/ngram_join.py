"""Exact n-gram Jaccard self-join by multiple-global-order filtering.

A document is the set of its distinct word shingles. Documents with equal sets form a class;
only classes are compared. Shingles have places in three global orders: rare first (by a hashed
count over the whole corpus), by ascending hash, and by descending hash. Two sets with
Jaccard ``T`` or more share a shingle among the first ``n - ceil(T n) + 1`` of both under every
order. The first order finds pairs: its prefixes are posted to partitions by shingle, and a
partition keeps the pairs that pass the length filter, and the positional filter or, of larger sets, have so many prefix
shingles in common there as one partition must see of a pair that links. The other two are
intersected with it where the sets of a candidate group meet, before verification: a pair
stays when the shingles that both prefixes share, and all that lies behind the prefixes, could
still reach the threshold. Between the two, a parity bitmap of each set bounds the overlap from above, so that
chance candidates neither move whole sets nor join groups. What is left is verified on the whole sets.
An order is a function of the shingle alone, so coarse counts cost candidates, never links.

Near copies share most of their prefix, so most partitions meet the same pair. Each posted class
carries a mark, one shingle from the later half of its prefix chosen by yet another permutation. Two classes
with the same mark are emitted by the partition of that mark alone, whatever the other filters say; other pairs
by every partition in which they pass. There are as many partitions as hold ``POSTED`` postings each: the fewer, the
more of a pair each of them sees.

What moves: prefix postings of one order as packed blocks (not rows), narrow pair tables, and bitmaps and sets
of the documents that have a candidate. A class that is the larger of a pair by its key takes the least partner as its
leader; in a group of near copies nearly all have one leader. A pair is judged in the cell of its larger end's leader,
and a bitmap or set goes to a cell once, however many pairs it has there. A cell with more than
``BLOCK`` shingles is cut into block pairs, so no task holds an unbounded group. The posting list of a shingle with
more than ``HOT`` classes is cut into blocks too, and its block pairs are dealt to all tasks. Nothing of corpus size is
broadcast: the counts are between 2**22 and ``MOST_BUCKETS`` bytes, by the bytes of text, and the membership
table of candidates is ``MEMBERS`` bits. Coarser counts and a fuller table cost candidates and traffic, never links.

Equality of shingles, and of sets, is that of 64-bit hashes.

Edge cases: null and empty texts, or texts without words, have no shingles, no links and
themselves as component; with fewer words than a shingle the whole sequence is one shingle;
rows that share a doc_id count as one document, whose text is that with the smallest digest
if they differ; each row with a null doc_id is returned by itself, without links or component,
and is kept by ``keep_one``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .common import cut, release, salted_join, ship
from .graph import components

WIDTH, PERCENT = 2, 60
#: Bytes of the count table: one for ``PER_BUCKET`` bytes of text, within these limits.
LEAST_BUCKETS, MOST_BUCKETS, PER_BUCKET, CHUNKS = 1 << 22, 1 << 26, 1 << 13, 16
BLOCK = 1 << 20
FLUSH = 1 << 18
MEMBERS = 1 << 22
HOT, POSTED = 1 << 12, 2_400_000


def _sets(col: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for i, j, buf, offs in X.blocks(col, 1 << 20):
        s, start = X.shingle_hashes(*X.word_hashes(buf, offs), width)
        for r in range(j - i):
            a = np.sort(s[start[r] : start[r + 1]])
            if len(a) > 1:
                keep = np.empty(len(a), bool)
                keep[0] = True
                np.not_equal(a[1:], a[:-1], out=keep[1:])
                a = a[keep]
            yield i + r, a


def _digest(a: np.ndarray) -> bytes:
    return hashlib.blake2b(a.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _bitmap(a: np.ndarray) -> bytes:
    """Parities of the shingles by hash position, on at least twice as many bits as shingles."""
    size = 1 << max(6, int(2 * len(a) - 1).bit_length())
    n = np.bincount((a >> X.U(40)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def _differing(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Differing bits of pairs of bitmaps, the longer ones folded to the length of the shorter: each is a shingle that one set alone has."""
    size = np.array([(len(x), len(y)) for x, y in zip(xs, ys)])
    out = np.zeros(len(size), np.int64)
    for lens in np.unique(size, axis=0):
        at = np.flatnonzero((size == lens).all(axis=1))
        least = int(lens.min())
        u, v = (np.bitwise_xor.reduce(np.frombuffer(b"".join(s[k] for k in at), np.uint8).reshape(len(at), -1, least), axis=1) for s in (xs, ys))
        out[at] = np.bitwise_count(u ^ v).sum(axis=1)
    return out


def shingle_sets(docs: DataFrame, buckets: int = LEAST_BUCKETS, width: int = WIDTH) -> DataFrame:
    """Per document (doc_id, n, digest of the set, key: its first 8 bytes, bitmap), and per task the hashed shingle counts in chunks (chunk, counts)."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(buckets, np.uint16), [], 0
        names = ["doc_id", "n", "digest", "key", "bits", "chunk", "counts"]

        def add() -> None:
            at, n = np.unique((np.concatenate(held) & X.U(buckets - 1)).astype(np.uint32), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 65535)
            held.clear()

        seen = False
        for b in batches:
            n, digest, bits = np.zeros(b.num_rows, np.int64), [b""] * b.num_rows, [b""] * b.num_rows
            for r, a in _sets(b.column("text"), width):
                n[r] = len(a)
                if len(a):
                    digest[r], bits[r] = _digest(a), _bitmap(a)
                held.append(a)
                size += len(a)
                if size > FLUSH:
                    add()
                    size = 0
            none = pa.nulls(b.num_rows)
            seen = seen or b.num_rows > 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), pa.array([_key(x) for x in digest], pa.int64()), pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if held:
            add()
        if seen:
            part = buckets // CHUNKS
            packed = [zlib.compress(counts[k * part : (k + 1) * part].tobytes(), 1) for k in range(CHUNKS)]
            none = pa.nulls(CHUNKS)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, digest binary, key long, bits binary, chunk int, counts binary")


def _fold(batches: Iterator[pd.DataFrame], summed: bool) -> Iterator[pd.DataFrame]:
    """Sum the count chunks of a partition while they stream by."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b["chunk"], b["counts"]):
            a = np.frombuffer(zlib.decompress(c), np.uint32 if summed else np.uint16)
            total.setdefault(k, np.zeros(len(a), np.uint32))
            np.minimum(total[k].astype(np.uint64) + a, 0xFFFFFFFF, out=total[k], casting="unsafe")
    if total:
        yield pd.DataFrame({"chunk": list(total), "counts": [zlib.compress(a.tobytes(), 1) for a in total.values()]})


def rarity(parts: DataFrame, buckets: int) -> np.ndarray:
    """For each hash bucket the rounded logarithm of its count."""
    schema = "chunk int, counts binary"
    once = parts.withColumn("s", F.pmod(F.xxhash64("counts"), F.lit(8))).repartition(CHUNKS * 2, "chunk", "s").select("chunk", "counts").mapInPandas(lambda x: _fold(x, False), schema)
    out = np.zeros(buckets, np.uint8)
    part = buckets // CHUNKS
    for r in once.repartition(CHUNKS, "chunk").mapInPandas(lambda x: _fold(x, True), schema).toLocalIterator():
        out[r["chunk"] * part : (r["chunk"] + 1) * part] = np.minimum(255, np.round(8 * np.log2(1.0 + np.frombuffer(zlib.decompress(r["counts"]), np.uint32))))
    return out


def _prefix(n: np.ndarray | int, percent: int):  # noqa: ANN202
    """Length of the prefix of a set of ``n`` shingles."""
    return n - (-(-percent * n // 100)) + 1


POSTINGS = "part int, keys binary, sizes binary, marks binary, counts binary, hashes binary, weights binary, places binary"


def prefix_postings(docs: DataFrame, shared: Broadcast, parts: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Packed blocks of prefix shingles in the rare-first order.

    A block has a table of classes (key, size, mark, number of postings) and, class by
    class, the upper half of each hash, its weight, and its place in 256ths of the prefix, rounded down.
    """
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        mask = X.U(len(rank) - 1)
        keys, sizes, marks, held, size = [], [], [], [], 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            k, n = np.array(keys, np.int64), np.array(sizes, np.uint32)
            mark = np.array(marks, X.U)
            h, w, at = (np.concatenate([x[c] for x in held]) for c in range(3))
            d = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[0]) for x in held])
            part = (h % X.U(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            h, w, at, d, part = (h[by] >> X.U(32)).astype(np.uint32), w[by], at[by], d[by], part[by]
            edge = np.searchsorted(part, np.arange(parts + 1))
            cols: list[list] = [[] for _ in range(8)]
            for p in np.flatnonzero(np.diff(edge)).tolist():
                here = slice(edge[p], edge[p + 1])
                use, count = np.unique(d[here], return_counts=True)
                for c, v in zip(cols, (p, *(x.tobytes() for x in (k[use], n[use], mark[use], count.astype(np.uint32), h[here], w[here], at[here])))):
                    c.append(v)
            for x in (keys, sizes, marks, held, seen):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=[c.split()[0] for c in POSTINGS.split(", ")])

        for b in batches:
            for _, a in _sets(b.column("text"), width):
                n = len(a)
                key = _key(_digest(a)) if n else 0
                if not n or key in seen:
                    continue
                seen.add(key)
                p = _prefix(n, percent)
                weight = rank[(a & mask).astype(np.int64)]
                place = (weight.astype(X.U) << X.U(56)) | (a >> X.U(8))
                first = np.argpartition(place, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.argsort(place[first])]
                at = (np.arange(p) * 256 // p).astype(np.uint8)
                late = place[first[p // 2 :]]  # what one document alone has comes first
                keys.append(key)
                sizes.append(n)
                marks.append(late[np.argmin(X.mix(late))])
                held.append((a[first], weight[first], at))
                size += p
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, POSTINGS)


class _Part:
    """Postings of one partition, sorted by shingle and then by the size of the class."""

    def __init__(self, blocks: list[tuple], percent: int) -> None:
        read = lambda i, t: np.concatenate([np.frombuffer(b[i], t) for b in blocks])
        keys, counts = read(0, np.int64), read(3, np.uint32).astype(np.int64)
        self.keys, first, code = np.unique(keys, return_index=True, return_inverse=True)
        self.sizes = sizes = read(1, np.uint32).astype(np.int64)[first]
        self.marks = read(2, X.U)[first]
        once = np.zeros(len(keys), bool)
        once[first] = True  # equal sets have equal postings: those of one copy are enough
        keep = np.repeat(once, counts)
        token = ((read(5, np.uint8).astype(np.int64) << 32) | read(4, np.uint32))[keep]
        cls, places = np.repeat(code, counts)[keep], read(6, np.uint8)[keep]
        # a shingle that one class alone has cannot make a pair
        by = np.argsort(token, kind="stable")
        new = np.diff(token[by], prepend=-1) != 0
        many = ~(new & np.append(new[1:], True))
        by = by[many]
        group = np.cumsum(new)[many]
        by, group = (x[np.lexsort((sizes[cls[by]], group))] for x in (by, group))
        self.token, self.group, self.cls = token[by], group, cls[by].astype(np.int32)
        self.n = sizes[self.cls]
        self.rest = self.n - places[by].astype(np.int64) * _prefix(self.n, percent) // 256  # members from this place on, or a few more

    def until(self, percent: int) -> np.ndarray:
        """For each posting, the end of those behind it that have the same shingle and pass the length filter."""
        return np.searchsorted((self.group << 32) | self.n, (self.group << 32) | (100 * self.n // percent), "right")


def _least_shared(n: np.ndarray, m: np.ndarray, parts: int, percent: int) -> np.ndarray:
    """Prefix shingles that sets of these sizes that link share in one of ``parts`` partitions at least.

    All that lies behind the prefixes may be shared, and the rest of the overlap is not in every partition below its mean.
    """
    behind = np.maximum(n - _prefix(n, percent), m - _prefix(m, percent))
    return -(-np.maximum(1, -(-percent * (n + m) // (100 + percent)) - behind) // parts)


def _passing(x, i: np.ndarray, j: np.ndarray, parts: int, percent: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Of the posting pairs (i, j): class pairs to emit at once, by their mark, and those to count, one for each shared shingle."""
    a, b = x.cls[i].astype(np.int64), x.cls[j].astype(np.int64)
    pair, mark = (np.minimum(a, b) << 32) | np.maximum(a, b), x.marks[a]
    same, other = mark == x.marks[b], a != b
    near = (100 + percent) * np.minimum(x.rest[i], x.rest[j]) >= percent * (x.n[i] + x.n[j])  # the positional filter
    near |= _least_shared(x.n[i], x.n[j], parts, percent) > 1  # it knows the first shared shingle; these are counted whole
    return pair[same & other & ((mark >> X.U(24)).astype(np.int64) == x.token[i])], pair[~same & other & near]


def _sum(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(pairs, kind="stable")
    pairs = pairs[by]
    start = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[start], np.add.reduceat(counts[by], start) if len(start) else counts[:0]


def _steps(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``FLUSH`` pairs in all."""
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, total[i] + FLUSH, "right")) - 1)
        yield i, j
        i = j


PAIRS = "a long, b long, token long, left binary, right binary"


def _found(keys: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    a, b = keys[pairs >> 32], keys[pairs & 0xFFFFFFFF]
    none = pa.nulls(len(a))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary())], names=["a", "b", "token", "left", "right"])


def _pairs(batches: Iterator[pa.RecordBatch], parts: int, percent: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that pass the filters of the first order, and block pairs of hot shingles, of each partition."""
    held: dict[int, list] = {}
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(8)]
        for part, *block in zip(*cols):
            held.setdefault(part, []).append(block)
    while held:
        x = _Part(held.popitem()[1], percent)
        if not len(x.token):
            continue
        start = np.flatnonzero(np.diff(x.group, prepend=-1))
        size = np.diff(np.append(start, len(x.group)))
        long = size > hot
        for s, n in zip(start[long], size[long]):
            yield from _hot_blocks(x, int(s), int(s + n), percent, hot)
        end = x.until(percent)
        count = end - np.arange(len(end)) - 1
        count[np.repeat(long, size)] = 0
        sure, some, size = [], (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        for i, j in _steps(count):
            left = np.repeat(np.arange(i, j), count[i:j])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count[i:j]) - count[i:j], count[i:j])
            by_mark, others = _passing(x, left, right, parts, percent)
            sure.append(by_mark)
            some = _sum(np.concatenate([some[0], others]), np.concatenate([some[1], np.ones(len(others), np.int64)]))
            size += len(by_mark)
            if size > FLUSH:
                yield _found(x.keys, np.concatenate(sure))
                sure, size = [], 0
            if len(some[0]) > 8 * FLUSH:  # too many to wait for their counts
                yield _found(x.keys, some[0])
                some = some[0][:0], some[1][:0]
        n, m = x.sizes[some[0] >> 32], x.sizes[some[0] & 0xFFFFFFFF]
        sure.append(some[0][some[1] >= _least_shared(n, m, parts, percent)])
        yield _found(x.keys, np.concatenate(sure))


class _Side:
    """Postings of one hot shingle in one block or two."""

    def __init__(self, token: int, data: list[bytes]) -> None:
        rows = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 4) for d in data])
        self.keys, self.n, self.rest, self.marks = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3].astype(X.U)
        self.cls, self.token = np.arange(len(rows)), np.full(len(rows), token)


def _hot_blocks(x: _Part, s: int, e: int, percent: int, hot: int) -> Iterator[pa.RecordBatch]:
    cls = x.cls[s:e]
    rows = np.column_stack([x.keys[cls], x.n[s:e], x.rest[s:e], x.marks[cls].astype(np.int64)])
    for k in range(0, e - s, hot):
        for m in range(k, e - s, hot):
            if 100 * rows[min(k + hot, e - s) - 1, 1] < percent * rows[m, 1]:
                break  # blocks are sorted by size: no pair passes the length filter from here on
            none = pa.nulls(1).cast(pa.int64())
            sides = [rows[k : k + hot].tobytes()], [rows[m : m + hot].tobytes() if m > k else None]
            yield pa.RecordBatch.from_arrays([none, none, pa.array([int(x.token[s])]), *[pa.array(c, pa.binary()) for c in sides]], names=["a", "b", "token", "left", "right"])


def _hot_pairs(batches: Iterator[pa.RecordBatch], parts: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for token, left, right in zip(*[b.column(c).to_pylist() for c in ("token", "left", "right")]):
            x = _Side(token, [left] if right is None else [left, right])
            half = len(left) // 32
            for i in range(half):
                j = np.arange(i + 1 if right is None else half, len(x.n))
                lo, hi = np.minimum(x.n[i], x.n[j]), np.maximum(x.n[i], x.n[j])
                j = j[100 * lo >= percent * hi]
                got = np.concatenate(_passing(x, np.full(len(j), i), j, parts, percent))
                if len(got):
                    yield _found(x.keys, got)


def candidates(docs: DataFrame, rank: Broadcast, parts: int, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(a, b, cell): keys (the first 8 bytes of the digests) of class pairs that pass the filters of the first order, and the leader of b."""
    posts = prefix_postings(docs, rank, parts, width, percent)
    found = cut(posts.repartitionById(parts, "part").mapInArrow(lambda x: _pairs(x, parts, percent, hot), PAIRS))
    release(docs)
    split = found.where("token IS NOT NULL").repartition(parts, F.xxhash64("token", "left", "right")).mapInArrow(lambda x: _hot_pairs(x, parts, percent), PAIRS)
    pairs = found.where("token IS NULL").unionByName(split).select("a", "b").repartition(parts, "b").groupBy("b", "a").agg(F.lit(1).alias("one"))
    # a class with very many partners is one group of narrow rows: its least partner combines as they stream by
    return pairs.select("a", "b").join(pairs.groupBy("b").agg(F.min("a").alias("cell")), "b")


def _cells(pairs: DataFrame) -> DataFrame:
    """(cell, key): the cells in which a class has a pair."""
    return pairs.select("cell", F.explode(F.array("a", "b")).alias("key")).distinct()


BITS = "cell long, kind int, a long, b long, n long, bits binary"


def _judge(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stream the rows of the cells (bitmaps first, then pairs) and keep the pairs whose bitmaps allow a link."""
    now, keys, sizes, bits, order = None, [], [], [], None
    for b in batches:
        cell, kind, x, y, n = (np.asarray(b.column(c)) for c in ("cell", "kind", "a", "b", "n"))
        edge = np.flatnonzero((np.diff(cell, prepend=cell[:1] - 1) != 0) | (np.diff(kind, prepend=kind[:1]) != 0))
        for s, e in zip(edge, np.append(edge[1:], b.num_rows)):
            if cell[s] != now:
                now, keys, sizes, bits, order = cell[s], [], [], [], None
            if kind[s] == 0:
                keys.append(x[s:e])
                sizes.append(n[s:e])
                bits += b.column("bits").slice(s, e - s).to_pylist()
                continue
            if order is None:
                k, m = np.concatenate(keys), np.concatenate(sizes)
                order = np.argsort(k, kind="stable")
                k, m = k[order], m[order]
            for f in range(s, e, 20_000):
                i, j = (np.searchsorted(k, z[f : min(f + 20_000, e)]) for z in (x, y))
                most = (m[i] + m[j] - _differing([bits[q] for q in order[i]], [bits[q] for q in order[j]])) // 2  # members in common
                ok = (100 + percent) * most >= percent * (m[i] + m[j])
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), now)), pa.array(k[i]), pa.array(k[j])], names=["cell", "a", "b"])


def likely(pairs: DataFrame, classes: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """The candidates (cell, a, b) without those that the bitmaps of their sets rule out."""
    own = classes.select("key", "n", "bits").dropDuplicates(["key"])
    left = _cells(pairs).join(own, "key").select("cell", F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(0).cast("long").alias("b"), "n", "bits")
    right = pairs.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("bits"))
    rows = left.unionByName(right).repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    return rows.mapInArrow(lambda x: _judge(x, percent), "cell long, a long, b long")


class _Sets:
    """The sets of a block: shingles as codes in ascending order of their hashes."""

    def __init__(self, nodes: list[int], data: list[bytes]) -> None:
        order = np.argsort(np.array(nodes, np.int64), kind="stable")
        self.nodes = np.array(nodes, np.int64)[order]
        sets = [np.frombuffer(data[i], X.U) for i in order]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        u, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.code, self.flag = code.astype(np.int32), np.zeros(len(u), bool)

    def shared(self, x: int, ys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Shingles that the parts [lo, hi) of x and of each of ys have in common; lo and hi by set, first for x."""
        own = self.code[self.at[x] + lo[0] : self.at[x] + hi[0]]
        size = hi[1:] - lo[1:]
        before = np.cumsum(size) - size
        idx = np.repeat(self.at[ys] + lo[1:] - before, size) + np.arange(int(size.sum()))
        self.flag[own] = True
        got = np.add.reduceat(self.flag[self.code[idx]].astype(np.int64), before)  # no part is empty
        self.flag[own] = False
        return got

    def links(self, x: int, ys: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``ys`` that link with ``x``: the filters of the second and third order, then the whole sets."""
        for order in ("ascending", "descending", "whole"):
            if not len(ys):
                break
            n = self.n[np.append(x, ys)]
            p, zero = _prefix(n, percent), np.zeros(len(n), np.int64)
            need = -(-percent * (n[0] + n[1:]) // (100 + percent))
            if order == "whole":
                return ys[self.shared(x, ys, zero, n) >= need]
            behind = np.maximum(n[0] - p[0], n[1:] - p[1:])
            ys = ys[self.shared(x, ys, *((zero, p) if order == "ascending" else (n - p, n))) + behind >= need]
        return ys


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stream the rows of the blocks (sets first, then pairs by x) and keep the pairs that link."""
    block, nodes, data, sets = None, [], [], None
    for b in batches:
        cell, i, j, kind, x, y = (np.asarray(b.column(c)) for c in ("cell", "i", "j", "kind", "x", "y"))
        edge = np.flatnonzero((np.diff(cell, prepend=cell[:1] - 1) != 0) | (np.diff(i, prepend=i[:1]) != 0) | (np.diff(j, prepend=j[:1]) != 0) | (np.diff(kind, prepend=kind[:1]) != 0))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(edge, np.append(edge[1:], b.num_rows)):
            if (cell[s], i[s], j[s]) != block:
                block, nodes, data, sets = (cell[s], i[s], j[s]), [], [], None
            if kind[s] == 0:
                nodes += x[s:e].tolist()
                data += b.column("data").slice(s, e - s).to_pylist()
                continue
            if sets is None:
                sets, data = _Sets(nodes, data), []
            px, py = np.searchsorted(sets.nodes, x[s:e]), np.searchsorted(sets.nodes, y[s:e])
            begin = np.flatnonzero(np.diff(px, prepend=-1))
            for s2, e2 in zip(begin, np.append(begin[1:], len(px))):
                total = np.cumsum(sets.n[py[s2:e2]])
                k = 0
                while k < len(total):  # temporaries are bounded
                    m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + FLUSH)))
                    got = sets.links(int(px[s2]), py[s2:e2][k:m], percent)
                    if len(got):
                        out.append((np.full(len(got), sets.nodes[px[s2]]), sets.nodes[got]))
                    k = m
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], names=["a", "b"])


def _slot(ids: np.ndarray) -> np.ndarray:
    return (X.mix(ids.astype(np.int64).view(X.U)) & X.U(MEMBERS - 1)).astype(np.int64)


def _is_member(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    s = _slot(ids)
    return (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1


def _members(nodes: DataFrame) -> np.ndarray:
    """A hashed membership table of ``MEMBERS`` bits: no node is missed, few others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(MEMBERS, bool)
        for b in batches:
            t[_slot(np.asarray(b.column(0)))] = True
        if t.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(t).tobytes(), 1)], pa.binary())], names=["t"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(MEMBERS // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                t |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary())], names=["t"])

    rows = nodes.select("node").mapInArrow(run, "t binary").repartition(1).mapInArrow(fold, "t binary").collect()  # one row
    return np.frombuffer(bytes(rows[0]["t"]), np.uint8) if rows else np.zeros(MEMBERS // 8, np.uint8)


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, parts: int, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b), by key, of ``pairs`` (cell, a, b) whose whole sets reach the threshold."""
    ship(docs)
    nodes = cut(_cells(pairs).join(classes.select("key", "rep", "n"), "key"))  # a class of each digest, should two share a key
    size = nodes.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(block))).cast("int").alias("g"))
    side = lambda x, g: F.pmod(F.xxhash64(x), F.col(g)).cast("int")
    p = salted_join(pairs, size, ["cell"], F.col("a"), "inner").select("cell", side("a", "g").alias("u"), side("b", "g").alias("v"), "a", "b")
    p = cut(p.select("cell", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "a", "b"))
    met = p.select("cell", "i", "j", F.explode(F.array("a", "b")).alias("key")).distinct()  # the block pairs in which a set has a candidate
    member = docs.sparkSession.sparkContext.broadcast(_members(nodes.select(F.col("rep").alias("node"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_is_member(member.value, np.asarray(b.column("node")))))
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                sets = [a for _, a in _sets(part.column("text"), width)]
                keys = [_key(_digest(a)) for a in sets]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(keys, pa.int64()), pa.array([a.tobytes() for a in sets], pa.binary())], names=["rep", "key", "data"])

    packed = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node IS NOT NULL").mapInArrow(run, "rep long, key long, data binary")
    own = met.join(nodes.select("key", "rep").distinct(), "key")
    left = packed.join(own.hint("shuffle_hash"), ["rep", "key"]).select("cell", "i", "j", F.lit(0).alias("kind"), F.col("key").alias("x"), F.lit(0).cast("long").alias("y"), "data")
    right = p.select("cell", "i", "j", F.lit(1).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), F.lit(None).cast("binary").alias("data"))
    rows = left.unionByName(right).repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "kind", "x")
    return rows.mapInArrow(lambda x: _verify(x, percent), "a long, b long")


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, n_similar, component_id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(size / PER_BUCKET + 1))))
    scan = cut(shingle_sets(docs, buckets, width))
    docs_ = scan.where("chunk IS NULL")
    sets = docs_.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("digest", "n", "key", "bits")).alias("s")).select("doc_id", "s.digest", "s.n", "s.key", "s.bits")
    rank = spark.sparkContext.broadcast(rarity(scan.where("chunk IS NOT NULL").select("chunk", "counts"), buckets))
    classes = cut(sets.where("n > 0").groupBy("digest", "key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    members = docs_.agg(F.sum("n")).first()[0] or 0
    posted = min(parts, max(spark.sparkContext.defaultParallelism, members * (100 - percent) // 100 // POSTED))
    found = cut(candidates(docs, rank, posted, width, percent))
    release(docs)
    pairs = cut(likely(found, classes, parts, percent))
    rank.destroy()  # all that needed it is in checkpoints
    release(docs)
    links = cut(verified(docs, pairs, classes, parts, width, percent))
    release(docs)
    # members of the classes that a class links with: one each, and the further copies of those that have any
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    further = classes.where("copies > 1").select(F.col("key").alias("b"), (F.col("copies") - 1).alias("more"))
    # each step is a narrow checkpoint of its own: one plan of them all holds every shuffle, and the metrics of every task, in the driver at once
    linked = cut(ends.groupBy("a").agg(F.count("*").alias("others")).unionByName(salted_join(ends, further, ["b"], F.col("a"), "inner").groupBy("a").agg(F.sum("more").alias("others"))).groupBy("a").agg(F.sum("others").alias("others")))
    release(docs)
    comp = cut(components(links).join(classes.select(F.col("key").alias("node"), "rep"), "node"))
    release(docs)
    comp = comp.join(comp.groupBy("component").agg(F.min("rep").alias("first")), "component").select("node", "first")
    by_class = classes.join(linked, F.col("key") == F.col("a"), "left").join(comp, F.col("key") == F.col("node"), "left").where("copies > 1 OR first IS NOT NULL")  # others are alone
    by_class = cut(by_class.select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("similar"), F.coalesce("first", "rep").alias("component")))
    release(docs)
    out = salted_join(sets.select("doc_id", "n", "digest"), by_class, ["digest"], F.col("doc_id"))
    known = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "doc_id").alias("component_id"))
    return known.unionByName(docs_.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id."""
    other = f"gone_{uuid.uuid4().hex}"
    gone = cut(similar(docs, width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(other)))
    release(docs)
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(other), "left_anti")
