"""Inconsistency patterns: each returns the violating rows of the triples that are still valid.

Every function takes ``valid`` (h, r, t, is_new), its pattern table, and where needed the
types (ent, cls). Pattern tables come from an ontology and are small next to the triples,
but nothing assumes it: they are plain join sides, so the planner broadcasts them when
their size allows. Triples meet triples only through equi-joins on an entity (and
relation), as semi-joins: no pair of violating rows is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import HRT

ROW = [*HRT, "is_new"]


def _new(valid: DataFrame) -> DataFrame:
    return valid.where("is_new")


def _by_type(valid: DataFrame, pattern: DataFrame, types: DataFrame, end: str, new_only: bool) -> DataFrame:
    """Rows whose head or tail has a class that the relation forbids; ``pattern``: (k relation, v class)."""
    bad = pattern.select(F.col("k").alias("r"), F.col("v").alias("cls")).distinct().join(types, "cls").select("r", F.col("ent").alias(end)).distinct()
    return (_new(valid) if new_only else valid).join(bad, ["r", end], "left_semi").select(*ROW)


def neg_domain(valid: DataFrame, pattern: DataFrame, types: DataFrame, new_only: bool = False) -> DataFrame:
    return _by_type(valid, pattern, types, "h", new_only)


def neg_range(valid: DataFrame, pattern: DataFrame, types: DataFrame, new_only: bool = False) -> DataFrame:
    return _by_type(valid, pattern, types, "t", new_only)


def _clash(valid: DataFrame, pattern: DataFrame, mine: str, other: str) -> DataFrame:
    """New rows of relation k that meet a valid row of relation v at an entity.

    The other side shrinks to distinct (relation, entity) keys before the join.
    """
    b = valid.select(F.col("r").alias("v"), F.col(other).alias(mine))
    keys = b.join(pattern.distinct(), "v").select(F.col("k").alias("r"), mine).distinct()
    return _new(valid).join(keys, ["r", mine], "left_semi").select(*ROW)


def domain_domain(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    return _clash(valid, pattern, "h", "h")


def domain_range(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    return _clash(valid, pattern, "h", "t")


def range_domain(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    return _clash(valid, pattern, "t", "h")


def range_range(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    return _clash(valid, pattern, "t", "t")


def _crowded(rows: DataFrame, end: str) -> DataFrame:
    """Keys (r, end) that occur more than once."""
    return rows.groupBy("r", end).agg(F.count("*").alias("_n")).where("_n > 1").select("r", end)


def functional(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    """New rows of a functional relation (pattern: one column k) whose head occurs more than once."""
    own = valid.join(pattern.select(F.col("k").alias("r")).distinct(), "r", "left_semi")
    return _new(own).join(_crowded(own, "h"), ["r", "h"], "left_semi").select(*ROW)


def _functional_sub(valid: DataFrame, pattern: DataFrame, end: str, theta: Column) -> DataFrame:
    """Pattern (k functional relation, v sub-relation), for v joined at ``end``; fires only where k has valid rows."""
    live = F.broadcast(pattern.distinct().join(valid.select(F.col("r").alias("k")).distinct(), "k", "left_semi"))  # no more rows than the pattern table
    own = valid.join(F.broadcast(live.select(F.col("v").alias("r")).distinct()), "r", "left_semi")
    a = _new(own).join(_crowded(own, end), ["r", end], "left_semi").select(*ROW)
    sup = live.join(valid.select(F.col("r").alias("k"), F.col("h").alias("h1"), F.col("t").alias("t1")), "k").select("v", "h1", "t1")
    at = F.col("a.h" if end == "h" else "a.t") == F.col("b.h1")
    b = _new(own).alias("a").join(sup.alias("b"), (F.col("a.r") == F.col("b.v")) & at & theta, "left_semi").select(*[f"a.{c}" for c in ROW])
    return a.unionByName(b).dropDuplicates(HRT)


def functional_sub(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    """v is a sub-relation of the functional k: heads that occur twice, or with another k-tail."""
    return _functional_sub(valid, pattern, "h", F.col("a.t") != F.col("b.t1"))


def functional_inverse(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    """The inverse of v is a sub-relation of the functional k: tails that occur twice, or whose k-value is another head."""
    return _functional_sub(valid, pattern, "t", F.col("a.h") != F.col("b.t1"))


def irreflexive(valid: DataFrame, pattern: DataFrame, new_only: bool = False) -> DataFrame:
    loops = (_new(valid) if new_only else valid).where("h = t")
    return loops.join(pattern.select(F.col("k").alias("r")).distinct(), "r", "left_semi").select(*ROW)


def asymmetric(valid: DataFrame, pattern: DataFrame) -> DataFrame:
    own = valid.join(pattern.select(F.col("k").alias("r")).distinct(), "r", "left_semi")
    mirror = own.select(F.col("t").alias("h"), "r", F.col("h").alias("t"))
    return _new(own).join(mirror, HRT, "left_semi").select(*ROW)


# --- types: new assertions (ent, cls) against accepted types and triples ---


def type_disjoint_class(new: DataFrame, pattern: DataFrame, types: DataFrame) -> DataFrame:
    """New types that some existing type of the entity excludes; pattern: (k class, v class)."""
    bad = types.select("ent", F.col("cls").alias("v")).join(pattern.distinct(), "v").select("ent", F.col("k").alias("cls")).distinct()
    return new.join(bad, ["ent", "cls"], "left_semi")


def _type_disjoint_rel(new: DataFrame, pattern: DataFrame, triples: DataFrame, end: str) -> DataFrame:
    bad = triples.select(F.col("r").alias("v"), F.col(end).alias("ent")).distinct().join(pattern.distinct(), "v").select("ent", F.col("k").alias("cls")).distinct()
    return new.join(bad, ["ent", "cls"], "left_semi")


def type_disjoint_domain(new: DataFrame, pattern: DataFrame, triples: DataFrame) -> DataFrame:
    """New types that exclude being the head of a relation the entity has; pattern: (k class, v relation)."""
    return _type_disjoint_rel(new, pattern, triples, "h")


def type_disjoint_range(new: DataFrame, pattern: DataFrame, triples: DataFrame) -> DataFrame:
    return _type_disjoint_rel(new, pattern, triples, "t")


# --- schema correctness: rows that no positive pattern supports ---


def _unsupported(rows: DataFrame, pattern: DataFrame, types: DataFrame, end: str) -> DataFrame:
    good = pattern.select(F.col("k").alias("r"), F.col("v").alias("cls")).distinct().join(types, "cls").select("r", F.col("ent").alias(end)).distinct()
    return rows.join(good, ["r", end], "left_anti").select(*rows.columns)


def outside_domain(rows: DataFrame, pattern: DataFrame, types: DataFrame) -> DataFrame:
    """Rows whose head has no class of the relation's domain; a relation without a pattern is wholly outside."""
    return _unsupported(rows, pattern, types, "h")


def outside_range(rows: DataFrame, pattern: DataFrame, types: DataFrame) -> DataFrame:
    return _unsupported(rows, pattern, types, "t")
