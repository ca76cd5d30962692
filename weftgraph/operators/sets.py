"""Set operations and dictionary encoding over triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HRT
from ..plans.checkpoints import cut


def difference(a: DataFrame, b: DataFrame, on: list[str] = HRT) -> DataFrame:
    """Rows of ``a`` without a match in ``b``; inputs are sets, so this equals dropping all that appear twice."""
    return a.join(b.select(*on).distinct(), on, "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates()


def intersection(a: DataFrame, b: DataFrame, on: list[str] = HRT) -> DataFrame:
    return a.dropDuplicates(on).join(b.select(*on).distinct(), on, "left_semi")


def symmetric_difference(a: DataFrame, b: DataFrame, on: list[str] = HRT) -> DataFrame:
    return difference(a, b, on).unionByName(difference(b, a, on))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both sets and of their intersection, from one pass over both."""
    both = a.select(*HRT, F.lit(1).alias("s")).unionByName(b.select(*HRT, F.lit(2).alias("s")))
    per = both.groupBy(*HRT).agg(F.bit_or("s").alias("s"))
    return per.agg(F.count_if(F.col("s") != 2).alias("n_a"), F.count_if(F.col("s") != 1).alias("n_b"), F.count_if(F.col("s") == 3).alias("n_both"))


def mirrored(t: DataFrame) -> DataFrame:
    """Rows (h, r, t) whose mirror (t, r, h) is there too."""
    m = t.select(F.col("t").alias("h"), "r", F.col("h").alias("t"))
    return t.join(m.distinct(), HRT, "left_semi")


def contains(t: DataFrame, probe: DataFrame) -> DataFrame:
    """``probe`` with ``is_true``: whether the triple is in ``t``."""
    known = t.select(*HRT).distinct().withColumn("is_true", F.lit(True))
    return probe.join(known, HRT, "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))


def neighbours(t: DataFrame, keys: DataFrame) -> DataFrame:
    """Adjacency lookup: triples that match the key columns (any of h, r, t) of ``keys``."""
    return t.join(keys.distinct(), [c for c in HRT if c in keys.columns], "left_semi")


def entities(t: DataFrame) -> DataFrame:
    return t.select(F.col("h").alias("ent")).unionByName(t.select(F.col("t").alias("ent"))).distinct()


def relations(t: DataFrame) -> DataFrame:
    return t.select("r").distinct()


def dictionary(values: DataFrame, column: str, first: int = 0) -> DataFrame:
    """(column, id): dense ids in the order of the values, from ``first``.

    Ids are ranks within range buckets plus the sizes of the buckets before, so that no task
    holds the whole dictionary.
    """
    v = values.select(column).where(F.col(column).isNotNull()).distinct().sort(column)
    placed = cut(v.withColumn("_p", F.spark_partition_id()))  # a second run of the sort could draw other bounds
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = placed.groupBy("_p").agg(F.max("_n").alias("c")).select("_p", (F.coalesce(F.sum("c").over(before), F.lit(0))).alias("_b"))
    return placed.join(starts, "_p").select(column, (F.col("_b") + F.col("_n") - 1 + first).cast("long").alias("id"))


def dense_ids(values: DataFrame, column: str, first: int = 0) -> DataFrame:
    """``dictionary`` for values that are few, such as relations and classes: one window."""
    v = values.select(column).where(F.col(column).isNotNull()).distinct()
    return v.select(column, (F.dense_rank().over(Window.orderBy(column)) - 1 + first).cast("long").alias("id"))


def encode(t: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Triples as ids; unmapped triples drop. ``ents`` and ``rels``: (value column, id)."""
    e, r = ents.columns[0], rels.columns[0]
    h = ents.select(F.col(e).alias("h"), F.col("id").alias("head"))
    o = ents.select(F.col(e).alias("t"), F.col("id").alias("tail"))
    return t.join(h, "h").join(o, "t").join(rels.select(F.col(r).alias("r"), F.col("id").alias("rel")), "r").select("head", "rel", "tail")


def decode(t: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    e, r = ents.columns[0], rels.columns[0]
    h = ents.select(F.col(e).alias("h"), F.col("id").alias("head"))
    o = ents.select(F.col(e).alias("t"), F.col("id").alias("tail"))
    return t.join(h, "head").join(o, "tail").join(rels.select(F.col(r).alias("r"), F.col("id").alias("rel")), "rel").select(*HRT)


def types_as_triples(types: DataFrame, relation: str | Column = "type") -> DataFrame:
    rel = F.lit(relation) if isinstance(relation, str) else relation
    return types.select(F.col("ent").alias("h"), rel.alias("r"), F.col("cls").alias("t")).distinct()


def split_types(t: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples whose tail is a class, and the others."""
    c = classes.select(F.col(classes.columns[0]).alias("t")).distinct()
    return t.join(c, "t", "left_semi").select(*HRT), t.join(c, "t", "left_anti").select(*HRT)


def without_relations(t: DataFrame, rels: list[str]) -> DataFrame:
    return t.where(~F.col("r").isin(rels)) if rels else t


def grouped_tails(t: DataFrame) -> DataFrame:
    """(r, h, tails): the sorted distinct tails of each relation and head."""
    return t.groupBy("r", "h").agg(F.array_sort(F.collect_set("t")).alias("tails"))


def exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(column)).drop(*([column] if column != name else []))
