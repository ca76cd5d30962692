"""The data model: triples, entity types, and schemas of the file kinds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLE = "h string, r string, t string"
SCORED = "h string, r string, t string, score double"
TYPE = "ent string, cls string"
PAIR = "k string, v string"
HRT = ["h", "r", "t"]


@dataclass
class Graph:
    """A knowledge graph under test.

    ``triples`` is what is scanned; ``accepted`` is what the graph already holds (None: everything
    is new). ``patterns`` has a DataFrame for each pattern name of ``operators.patterns``. ``flags``, where
    it is known, has each distinct triple once with ``is_new``, and saves the join of both.
    """

    triples: DataFrame
    types: DataFrame
    accepted: DataFrame | None = None
    patterns: dict[str, DataFrame] = field(default_factory=dict)
    flags: DataFrame | None = None

    def flagged(self) -> DataFrame:
        """The distinct triples with ``is_new``: not among the accepted ones."""
        if self.flags is not None:
            return self.flags.select(*HRT, "is_new")
        if self.accepted is None:
            return triple_set(self.triples).select(*HRT, F.lit(True).alias("is_new"))
        known = self.accepted.select(*HRT).distinct().withColumn("_known", F.lit(True))
        return triple_set(self.triples).join(known, HRT, "left").select(*HRT, F.col("_known").isNull().alias("is_new"))


def as_set(t: DataFrame) -> DataFrame:
    """Mark ``t``, whose triples are known to be distinct, so that ``triple_set`` need not shuffle them."""
    t._is_set = True
    return t


def is_set(t: DataFrame) -> bool:
    return bool(t.__dict__.get("_is_set"))


def subset(t: DataFrame, condition: str) -> DataFrame:
    """The triples of ``t`` that meet the condition; a set if ``t`` is one."""
    s = t.where(condition)
    return as_set(s) if is_set(t) else s


def triple_set(t: DataFrame) -> DataFrame:
    """The distinct triples of ``t``."""
    s = t.select(*HRT)
    return as_set(s if is_set(t) else s.distinct())
