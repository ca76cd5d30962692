"""Toxicity by a weighted lexicon.

The lexicon is learned from labelled rows: a word's evidence is the number of distinct
(word before, word) pairs it has in toxic and in clean documents, so that copies of one
document count once, and its weight is the smoothed log odds. Entries are whole words and word
beginnings (compounds and inflections share those); a word counts by its best entry. Matching is one Aho-Corasick
pass over the folded text (case, accents of look-alike letters from other scripts, digits
and signs that stand for letters). Hits must be whole words; those covered by an exception
phrase (a stated list, and word pairs learned from clean documents) do not count. The sum
of weights is normalised by the square root of the length and passed through a logistic
curve fitted on the same rows.

Labels only enter training, through at most ``SAMPLE`` labelled rows (those with the
smallest hashes); scoring reads nothing but the text. Scoring shuffles nothing. The lexicon and the
learned exceptions are whole: what bounds the model that is broadcast is the sample alone (an entry needs
``MIN_PAIRS`` distinct toxic pairs of it, an exception is a pair of it). Folding and matching take time in
proportion to the text, runs of one character included.

Edge cases: null or empty texts score like any text without hits; very long texts are scored whole; without usable labels the
lexicon is empty and all scores are 0; labels that contradict each other for a doc_id count
as toxic if any says so; repeated rows score alike; extra columns pass through ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

SAMPLE = 20_000
MIN_PAIRS, MIN_ODDS, MIN_CLEAN = 8, math.log(8), 5
STEM = (5, 7)  # lengths of the word beginnings that may be entries
PHRASES = ("trash can", "trash cans", "trash bin", "class clown", "clown fish", "pond scum", "stupid mistake of mine")

_LOOKALIKE = dict(zip("аеорсухіјѕԁһӏνοαερτυικηωβ", "aeopcyxijsdhlvoaeptuiknwb")) | dict(zip("０１２３４５６７８９", "0123456789"))
_FOLD = str.maketrans(_LOOKALIKE | {c: None for c in "​‌‍⁠﻿­"})
_SIGNS = str.maketrans("013457@$!", "oieastasi")
_SIGNED = re.compile(r"(?<![a-z013457@$!])[a-z]*+[013457@$!][a-z013457@$!]*+")  # a run with a sign; it can only begin where a run begins
_FULLWIDTH = {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD.update(_FULLWIDTH)
_WORD = re.compile(r"[^\W\d_]+")


def _letters(m: re.Match) -> str:
    """A run with signs: those before its last letter are letters."""
    end = len(m[0].rstrip("013457@$!"))
    return m[0][:end].translate(_SIGNS) + m[0][end:]


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin letters, and digits or signs inside words to letters."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    return _SIGNED.sub(_letters, t) if any(c in t for c in "013457@$!") else t


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset(PHRASES)
    slope: float = 1.0
    offset: float = -30.0
    _auto: object = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_auto": None}

    def raw(self, text: str | None) -> float:
        """Weight of the hits over the square root of the length in hundreds of words."""
        if not text or not self.weights:
            return 0.0
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for key in {w.rstrip("*") for w in self.weights} | self.exceptions:
                self._auto.add_word(key, (len(key), self.weights.get(key, 0.0), self.weights.get(key + "*", 0.0), key in self.exceptions))
            self._auto.make_automaton()
        t = fold(text)
        hits: dict[int, tuple[float, int]] = {}  # where a word starts: the highest weight there, and where that entry ends
        free, n = [], len(t)
        for end, (size, word, stem, good) in self._auto.iter(t):
            start = end - size + 1
            if start and t[start - 1].isalpha():
                continue
            inside = end + 1 < n and t[end + 1].isalpha()
            if good and not inside:
                free.append((start, end))
            w = stem if inside else max(stem, word)
            if w > hits.get(start, (0.0,))[0]:
                hits[start] = (w, end)
        if not hits:
            return 0.0
        total, k = 0.0, 0
        free.sort()
        reach = -1
        for a in sorted(hits):
            while k < len(free) and free[k][0] <= a:
                reach = max(reach, free[k][1])
                k += 1
            if reach < hits[a][1]:
                total += hits[a][0]
        return total / math.sqrt(1.0 + t.count(" ") / 100.0)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * self.raw(text) + self.offset)))) if self.weights else 0.0


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct (word before, word) pairs of each batch, by label."""
    for b in batches:
        seen: set[tuple[str, str, int]] = set()
        for text, toxic in zip(b["text"], b["toxic"]):
            w = ["", *_WORD.findall(fold(text or ""))]
            seen.update((x, y, toxic) for x, y in zip(w, w[1:]))
            if len(seen) > 500_000:
                yield pd.DataFrame(list(seen), columns=["before", "word", "toxic"])
                seen.clear()
        if seen:
            yield pd.DataFrame(list(seen), columns=["before", "word", "toxic"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model on documents whose labels are given; ``labels`` has doc_id and toxic."""
    ship(docs)
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    pairs = rows.mapInPandas(_evidence, "before string, word string, toxic int").distinct()
    flag = lambda v: F.count_if(F.col("toxic") == v)
    pairs = cut(pairs)
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word"))), lambda k: F.concat(F.substr("word", F.lit(1), k), F.lit("*")))
    forms = F.concat(F.array("word"), F.when(F.length("word") >= STEM[0], stems).otherwise(F.array().cast("array<string>")))
    words = pairs.select("toxic", F.explode(forms).alias("entry")).groupBy("entry").agg(flag(1).alias("t"), flag(0).alias("c"))
    n_t, n_c = pairs.agg(flag(1), flag(0)).first()
    if not n_t or not n_c:
        return Model()
    odds = F.log((F.col("t") + 0.5) / float(n_t)) - F.log((F.col("c") + 0.5) / float(n_c))
    chosen = cut(words.where(f"t >= {MIN_PAIRS}").select("entry", odds.alias("w")).where(F.col("w") >= MIN_ODDS))
    model = Model({r["entry"]: float(r["w"]) for r in chosen.collect()})  # bounded by the sample
    if not model.weights:
        return model
    # the learned exceptions are pairs of a word that the lexicon meets which clean documents have and toxic ones never
    met = pairs.select("before", "word", "toxic", F.explode(forms).alias("entry")).join(F.broadcast(chosen), "entry", "left_semi")
    clean = met.groupBy("before", "word").agg(F.max("toxic").alias("bad")).where("bad = 0 AND before <> ''")
    learned = clean.groupBy("word").agg(F.collect_list("before").alias("by")).where(F.size("by") >= MIN_CLEAN)
    model.exceptions = frozenset(PHRASES) | {f"{x} {r['word']}" for r in learned.collect() for x in r["by"]}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [shared.value.raw(t) for t in b["text"]], "y": b["toxic"]})

    xy = rows.mapInPandas(features, "x double, y int").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").collect()  # at most ``sample`` rows
    model.slope, model.offset = _logistic(np.array([r["x"] for r in xy]), np.array([r["y"] for r in xy], float), np.array([r["n"] for r in xy], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression, by damped Newton steps with a little ridge."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(n * (y - p) * x) - 1e-3 * a, np.sum(n * (y - p))])
        v = n * p * (1 - p) + 1e-9
        h = np.array([[np.sum(v * x * x) + 1e-3, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def train_fold(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learned from all folds but the held-out one."""
    return train(docs, labels.where(~held_out()))


def held_out():  # noqa: ANN201
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    ship(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(t.as_py()) for t in b.column("text")], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs``, all columns, without those that score ``limit`` or more."""
    ship(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < limit for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
