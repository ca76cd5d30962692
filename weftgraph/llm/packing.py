"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenized (words are looked up once a worker, so a repeated word costs no BPE),
ended by id 0 and cut into pieces of at most ``CAPACITY`` tokens; only longer documents are
cut. The length histogram has at most ``CAPACITY`` bins, and a configuration is a multiset
of lengths that fits one sequence. The program is: fewest sequences, in fractions, whose configurations
cover the histogram. It is solved by multiplicative weights: each length has a dual price, which starts at its
share of a sequence; a knapsack dynamic program finds the configuration of the highest price; some of it is
taken; and the prices of the lengths it holds fall by a factor for good, the more the larger the part of their
need that was met. When every need is met the amounts are a fractional solution; rounds go on, and are averaged, until it is
near the bound that the prices give, or for ``ROUNDS`` rounds. It is rounded down to whole
sequences, and the pieces that are left over are covered by whole configurations priced with the same duals,
with premiums for long pieces. Where that doesn't meet the lower bound, best-fit decreasing over what is left, and over
the whole histogram, is tried too; the fewest sequences count.
Solving needs the histogram alone, on the driver, in time that depends on the number of lengths and not on their
counts.

A pricing looks at ``PRICED`` lengths, spread over all and others each time (partial pricing).

Pieces learn their place from their rank within their length. Ranks come from counts by
(length, hash bucket); there are enough buckets for ``PER_RANK`` pieces of the most frequent length in each, so no
task ranks a hot length. What is broadcast is the list of configurations, bounded by the number of lengths.

Edge cases: null and empty texts are the single token 0; texts of any length are tokenized whole; repeated rows are
packed each; a null doc_id is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import cut, ship

CAPACITY, CACHE, PARTS = 2048, 1_000_000, 100_000
PER_RANK = 100_000
#: Lengths of a pricing, rate of the weights in the first round (it falls with the root of the round), share of the least need that a step meets, and the premiums for long pieces that rounding tries.
PRICED, RATE, SHARE, PREMIUMS = 128, 0.5, 0.5, (0.0, 0.1)
#: Rounds end at this part above the lower bound, and after so many at the latest, as the driver solves alone.
GAP, ROUNDS = 0.002, 8
#: No price falls below this, so that a length is worth something beside those of its pricing however often it was met.
LEAST = 1e-300
#: Part of the highest price that taking an item costs, so that no ties are taken.
TINY = 1e-12
#: Words whose normal form is their lower case, and how the tokenizer parts those.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The byte-level alphabet: bytes without a printable Latin-1 character go to code points from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
_words: dict = {}


class Words:
    """Token ids of white-space separated words, kept by a hash of the bytes of the word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, tuple[int, ...]] = {}
        self.keys = np.zeros(0, X.U)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has; printable ASCII and Latin-1 letters need no normalising but lower case."""
        ids, count, model, known = [], [], self.tokenizer.model, self.parts
        for w in words:
            before = len(ids)
            if w.isascii() and w.isalpha():
                parts = [w.lower()]
            elif _PLAIN.fullmatch(w) is None or "<|" in w:
                ids += self.tokenizer.encode(w, add_special_tokens=False).ids
                parts = []
            else:
                parts = _PARTS.findall(w.lower())
            for part in parts:
                got = known.get(part)
                if got is None:
                    if len(known) >= PARTS:
                        known.clear()
                    got = known[part] = tuple([t.id for t in model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES))])
                ids += got
            count.append(len(ids) - before)
        return np.array(ids, np.uint32), np.array(count, np.int64)

    def learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of every word among ``keys``, once those not seen before are in it."""
        uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
        p = np.searchsorted(self.keys, uniq)
        new = self.keys[np.minimum(p, len(self.keys) - 1)] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if not new.any():
            return p[back]
        if len(self.keys) + new.sum() > CACHE and len(self.keys):
            self.forget()
            return self.learn(buf, starts, ends, h)
        data, at, to = buf.tobytes(), at[new], p[new]
        ids, count = self._encode([data[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        self.keys, self.first, self.count = np.insert(self.keys, to, uniq[new]), np.insert(self.first, to, first), np.insert(self.count, to, count)
        return (p + np.cumsum(new) - new)[back]

    def encode(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every row, ended by 0."""
        for i, j, buf, offs in X.blocks(col):
            own, offs = buf[offs[0] : offs[-1]], offs - offs[0]
            h, starts, ends, first = words(own, offs)
            p = self.learn(own, starts, ends, h)
            count, src = self.count[p], self.first[p]
            total = np.concatenate([[0], np.cumsum(count)])
            flat = self.ids[np.repeat(src - total[:-1], count) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
            edge = total[first]
            for r in range(j - i):
                yield np.append(flat[edge[r] : edge[r + 1]], np.uint32(0))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (case kept), start and end of every word, and the number of words before each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, X.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~X.SPACE[buf]
    fresh = np.zeros(n + 1, bool)
    fresh[offs] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:n]
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    st, en = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(st), X.U)
    # powers restart in every segment, so very long texts need no longer tables
    seg = X.SEGMENT
    power, inverse = X._powers(seg)
    total = np.zeros(n + 1, X.U)
    for s in range(0, n, seg):
        e = min(s + seg, n)
        np.cumsum((buf[s:e].astype(X.U) + X.U(1)) * power[: e - s], out=total[s + 1 : e + 1])
    same = (st // seg) == ((en - 1) // seg)
    low = np.where(st % seg == 0, X.U(0), total[st])
    out = X.mix((total[en] - low) * inverse[st % seg])
    for k in np.flatnonzero(~same):  # the few words across an edge
        v = X.U(0)
        for c in buf[st[k] : en[k]][::-1].tolist():
            v = v * power[1] + X.U(c + 1)
        out[k] = X.mix(np.array([v]))[0]
    rows = np.searchsorted(offs, st, "right") - 1
    return out, st, en, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offs) - 1))]).astype(np.int64)


def _worker(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): tokenized documents in pieces of at most ``capacity``."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker(path)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            with np.errstate(over="ignore"):
                for r, ids in enumerate(coder.encode(b.column("text"))):
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        for c, v in zip(out, (r, k, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), part if keep_ids else None)):
                            c.append(v)
            cols = [b.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(out[5], pa.list_(pa.int32()))] if keep_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) of the configurations that cover the histogram exactly."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    amounts, price = fractional(lengths, need, capacity)
    taken, left = [], need.copy()
    for config, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        times = min(int(amount + 1e-9), *(int(left[i]) // m for i, m in config))
        if times:
            taken.append((times, config))
            for i, m in config:
                left[i] -= times * m
    bound, best = lower_bound(histogram, capacity), None
    for premium in PREMIUMS:
        plan = taken + _cover(lengths, left.copy(), price * (1 + premium * lengths / capacity), capacity)
        if best is None or sum(n for n, _ in plan) < sum(n for n, _ in best):
            best = plan
        if sum(n for n, _ in best) <= bound:
            break
    else:
        best = min(best, taken + best_fit(lengths, left, capacity), best_fit(lengths, need, capacity), key=lambda x: sum(n for n, _ in x))
    return [(n, {int(lengths[i]): m for i, m in config}) for n, config in best]


def fractional(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[dict[tuple, float], np.ndarray]:
    """Amounts of configurations, as ((index, number), ...), that cover ``need``, and the dual prices, by multiplicative weights.

    A round meets every need once more. Amounts are averaged over the rounds since the last power of two, as early prices
    are poor. Any prices bound the program from below: their worth of ``need`` by the best configuration of all lengths. Rounds end
    when the best average is within ``GAP`` of the best bound, or at the whole number that the bound asks for; after ``ROUNDS``
    of them the average and its gap stand as they are.
    """
    price, met, amounts, step = lengths / capacity, np.zeros(len(lengths)), {}, 0
    bound = max(float(price @ need), float(need[2 * lengths > capacity].sum()))
    best, value, rounds, first = {}, math.inf, 0, 0
    while len(lengths) and value > max((1 + GAP) * bound, math.ceil(bound - 1e-9)) + 1e-9 and rounds < ROUNDS:
        if rounds & (rounds - 1) == 0:
            amounts, met, first = {}, np.zeros(len(lengths)), rounds
        rounds += 1
        goal, rate = rounds - first, RATE / math.sqrt(rounds)
        while len(live := np.flatnonzero(met < goal)):
            # lengths whose need is met can still fill a sequence, at their price
            config = _knapsack(lengths, price, need, _some(live, np.flatnonzero(met >= goal), step), capacity)
            if all(met[i] >= goal for i, _ in config):  # what lags has become too cheap beside what is met: it goes first
                config = _knapsack(lengths, price, need, _some(live, live[:0], step), capacity)
            part = max(SHARE, min(1.0, max(goal - met[i] for i, _ in config)))
            amount = part * min(need[i] / m for i, m in config)
            for i, m in config:
                met[i] += amount * m / need[i]
                price[i] = max(price[i] * math.exp(-rate * amount * m / need[i]), LEAST)
            amounts[config] = amounts.get(config, 0.0) + amount
            step += 1
        if (now := sum(amounts.values()) / met.min()) < value:
            best, value = {c: x / met.min() for c, x in amounts.items()}, now
        price /= price.max()
        top = sum(price[i] * m for i, m in _knapsack(lengths, price, need, np.arange(len(lengths)), capacity))
        bound = max(bound, float(price @ need) / top)
    return best, price / price.max(initial=1e-300)


def _some(live: np.ndarray, rest: np.ndarray, step: int) -> np.ndarray:
    """At most ``PRICED`` indices, three quarters of them live, spread evenly and turned with the step."""
    def pick(x: np.ndarray, n: int) -> np.ndarray:
        return x if len(x) <= n else x[(np.arange(n) * len(x) // n + step * 7919) % len(x)]

    own = pick(live, PRICED - min(len(rest), PRICED // 4))
    return np.unique(np.concatenate([own, pick(rest, PRICED - len(own))]))


def _cover(lengths: np.ndarray, left: np.ndarray, price: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Whole configurations of the highest price, one after the other, until nothing is left."""
    out, step = [], 0
    while len(live := np.flatnonzero(left)):
        config = _knapsack(lengths, price, left, _some(live, live[:0], step), capacity)
        times = min(int(left[i]) // m for i, m in config)
        times = times if times < 8 else times // 2
        for i, m in config:
            left[i] -= times * m
        out.append((times, config))
        step += 1
    return out


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Best-fit decreasing over counts: sequences of equal contents are one group."""
    groups: dict[tuple, int] = {}  # (free, contents as pairs) -> sequences
    for i in np.flatnonzero(left).tolist():  # lengths descend
        length, n = int(lengths[i]), int(left[i])
        while n:
            key = min((k for k in groups if k[0] >= length), key=lambda k: k[0], default=(capacity, ()))
            free, held = key
            fits = min(free // length, n)
            have = groups.pop(key, -(-n // fits))
            full = min(have, n // fits)
            parts = [(full, fits), (1, n - full * fits) if full < have and key == (capacity, ()) else (have - full, 0)]
            for count, m in parts:
                if count:
                    g = (free - m * length, (*held, (i, m)) if m else held)
                    groups[g] = groups.get(g, 0) + count
                    n -= count * m
    return [(c, held) for (_, held), c in groups.items() if held]


def _knapsack(lengths: np.ndarray, price: np.ndarray, limit: np.ndarray, among: np.ndarray, capacity: int) -> tuple:
    """((index, number), ...) of the highest price that fits, with at most ``limit`` of each length, by dynamic programming.

    A length that fits several times stands for 1, 2, 4, ... pieces, so each item is taken or not.
    """
    items: list[tuple[int, int, int, float]] = []
    worth = price[among] / price[among].max()
    for i, n, w, v in zip(among.tolist(), np.minimum(limit[among], capacity // lengths[among]).tolist(), lengths[among].tolist(), worth.tolist()):
        m = 1
        while n > 0:
            k = min(m, n)
            if v * k > TINY:  # others are never taken
                items.append((i, k, w * k, v * k - TINY))
            n -= m
            m *= 2
    best, took, room = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool), np.empty(capacity + 1)
    for row, (_, _, w, v) in zip(took, items):
        rest, value = best[w:], room[w:]
        np.add(best[: capacity + 1 - w], v, out=value)
        np.greater(value, rest, out=row[w:])
        np.maximum(value, rest, out=rest)
    c, pick = int(best.argmax()), {}
    for k in range(len(items) - 1, -1, -1):
        if took[k, c]:
            i, m, w, _ = items[k]
            pick[i] = pick.get(i, 0) + m
            c -= w
    return tuple(sorted(pick.items()))


def _runs(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Ranks of each length to sequences: arrays sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, config in plan:
        at = 0
        for length, m in sorted(config.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, m, at))
            used[length] = used.get(length, 0) + m * times
            at += m * length
        sequence += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(a.T)


def pack(piece: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``piece`` with sequence_id and offset."""
    ship(piece)
    piece = cut(piece)
    rows = piece.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row a length
    ranks = max([1, *(-(-int(r["n"]) // PER_RANK) for r in rows)])
    piece = piece.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranks)).cast("int"))
    counts = piece.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranks`` rows a length
    starts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    runs = _runs(solve({int(r["length"]): int(r["n"]) for r in rows}, capacity))
    shared = piece.sparkSession.sparkContext.broadcast(runs)
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = piece.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, base, m, at = shared.value
        key = (length << 44) | first
        for b in batches:
            size, rank = (np.asarray(b.column(c)).astype(np.int64) for c in ("length", "_rank"))
            r = np.searchsorted(key, (size << 44) | rank, "right") - 1
            t = rank - first[r]
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base[r] + t // m[r]), pa.array(at[r] + (t % m[r]) * size)], names=[*names, "sequence_id", "offset"])

    schema = ranked.select(names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: by tokens, and by pieces of more than half a sequence."""
    return max(math.ceil(sum(k * n for k, n in histogram.items()) / capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)
