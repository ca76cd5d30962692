"""Splits, query sets, negative sampling and repairs. Random choices are hashes of the row and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HRT, triple_set
from ..plans.checkpoints import cut
from .rules import functionality


def draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def bernoulli(t: DataFrame) -> DataFrame:
    """(r, p_head): how often to corrupt the head: tails per head over the sum of both ratios."""
    f = functionality(t)
    return f.select("r", F.round(F.col("tails_per_head") / (F.col("tails_per_head") + F.col("heads_per_tail")), 6).alias("p_head"))


def corrupt(t: DataFrame, ents: DataFrame, n: int, seed: int = 0, filtered: bool = True) -> DataFrame:
    """``n`` corruptions of every triple by Bernoulli sides: (h, r, t, i, side, ch, ct).

    Entities get dense ids, and a corruption draws an id, so the join is on an id, never a
    cross join. With ``filtered``, corruptions that are triples drop.
    """
    from .sets import dictionary

    ids = dictionary(ents, "ent")
    size = ids.count()
    p = bernoulli(t)
    c = t.join(p, "r").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    c = c.withColumn("side", F.when(draw(seed, *HRT, "i") < F.col("p_head"), "h").otherwise("t")).withColumn("id", F.floor(draw(seed + 1, *HRT, "i") * size).cast("long"))
    c = c.join(ids.withColumnRenamed("ent", "e"), "id")
    out = c.select(*HRT, "i", "side", F.when(F.col("side") == "h", F.col("e")).otherwise(F.col("h")).alias("ch"), F.when(F.col("side") == "t", F.col("e")).otherwise(F.col("t")).alias("ct"))
    if filtered:
        out = out.join(t.select(F.col("h").alias("ch"), "r", F.col("t").alias("ct")).distinct(), ["ch", "r", "ct"], "left_anti").select(*HRT, "i", "side", "ch", "ct")
    return out


def weighted_negatives(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k negatives of each triple by weighted sampling without replacement, over (h, r, t, candidate, weight).

    Known positives weigh 0, consistent ones 1, inconsistent ones 2, given ones 10: each draws -ln(u) / weight, the smallest win.
    """
    key = -F.log(draw(seed, *HRT, "candidate") + 1e-18) / F.col("weight")
    w = Window.partitionBy(*HRT).orderBy("_k", "candidate")
    return pool.where("weight > 0").withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_k", "_n")


def dev_split(t: DataFrame, percent: int = 10, seed: int = 0) -> DataFrame:
    """``t`` with ``dev``: about ``percent`` of each relation, and of one with two rows or more the row with the least draw.

    A row is only held out if its relation and both entities stay in the training part.
    A relation's least draw is combined before the shuffle, so that a hot relation is not one task.
    """
    a = t.select(*HRT).distinct().withColumn("_d", draw(seed, *HRT))
    least = a.groupBy("r").agg(F.min("_d").alias("_least"), F.count("*").alias("_rows"))
    a = a.join(least, "r").withColumn("_out", (F.col("_d") < percent / 100.0) | ((F.col("_rows") > 1) & (F.col("_d") == F.col("_least")) & F.lit(percent > 0)))
    dev, train = a.where("_out").select(*HRT), a.where("NOT _out").select(*HRT)
    ents = train.select(F.col("h").alias("e")).unionByName(train.select(F.col("t").alias("e"))).distinct()
    safe = dev.join(ents.withColumnRenamed("e", "h"), "h", "left_semi").join(ents.withColumnRenamed("e", "t"), "t", "left_semi").join(train.select("r").distinct(), "r", "left_semi")
    return a.select(*HRT).join(safe.select(*HRT, F.lit(True).alias("dev")), HRT, "left").withColumn("dev", F.coalesce("dev", F.lit(False)))


def dev_split_by(t: DataFrame, key: Column) -> DataFrame:
    """As ``dev_split``, for a given choice: ``key`` is true for rows that may be held out."""
    a = t.select(*HRT).distinct().withColumn("_d", key)
    train = a.where("NOT _d")
    ents = train.select(F.col("h").alias("e")).unionByName(train.select(F.col("t").alias("e"))).distinct()
    safe = a.where("_d").join(ents.withColumnRenamed("e", "h"), "h", "left_semi").join(ents.withColumnRenamed("e", "t"), "t", "left_semi").join(train.select("r").distinct(), "r", "left_semi")
    return safe.select(*HRT)


def query_sets(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One triple for each (h, r), and one for each (r, t) that the first set does not hold: the smallest ones."""
    hr = t.groupBy("h", "r").agg(F.min("t").alias("t")).select(*HRT)
    rt = t.groupBy("r", "t").agg(F.min("h").alias("h")).select(*HRT)
    return hr, rt.join(hr, HRT, "left_anti")


def relation_categories(t: DataFrame, limit: float = 1.5) -> DataFrame:
    """(r, category): 1-1, 1-N, N-1 or N-N by mean heads a tail and tails a head."""
    side = lambda c: F.when(F.col(c) >= limit, "N").otherwise("1")
    return functionality(t).select("r", F.concat(side("heads_per_tail"), F.lit("-"), side("tails_per_head")).alias("category"))


def frequent_relations(t: DataFrame, share: float) -> DataFrame:
    """The most frequent relations that together cover ``share`` of the triples: (r, n)."""
    c = t.groupBy("r").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "r")  # a row a relation
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return c.withColumns({"_b": before, "_t": total}).where(F.col("_b") < share * F.col("_t")).select("r", "n")


def fill_types(types: DataFrame, t: DataFrame, domain: DataFrame, range_: DataFrame) -> DataFrame:
    """Types (ent, cls) for untyped entities: the first class of a domain or range that their triples imply."""
    d = t.join(domain.select(F.col("k").alias("r"), F.col("v").alias("cls")), "r").select(F.col("h").alias("ent"), "cls")
    r = t.join(range_.select(F.col("k").alias("r"), F.col("v").alias("cls")), "r").select(F.col("t").alias("ent"), "cls")
    first = d.unionByName(r).distinct().groupBy("ent").agg(F.min("cls").alias("cls"))  # the least of a text sorts its rows, so they are made few first
    return first.join(types.select("ent").distinct(), "ent", "left_anti")


def fill_constraints(rels: DataFrame, table: DataFrame, prefix: str) -> DataFrame:
    """Pattern table (k, v) with a class ``<prefix>_<relation>`` for each relation that has none."""
    missing = rels.select(F.col("r").alias("k")).distinct().join(table.select("k").distinct(), "k", "left_anti")
    return table.select("k", "v").unionByName(missing.select("k", F.concat(F.lit(prefix + "_"), "k").alias("v")))


def inductive_drop(t: DataFrame, share: float, seed: int = 0, min_triples: int = 100) -> DataFrame:
    """Entities to hold out: about ``share`` of them, such that no other entity loses all its edges and no relation falls below ``min_triples``.

    Candidates that would leave a neighbour alone give way; relations that would starve keep all their triples.
    """
    t = cut(triple_set(t))
    e = t.select(F.col("h").alias("a"), F.col("t").alias("b")).unionByName(t.select(F.col("t").alias("a"), F.col("h").alias("b"))).where("a <> b")
    drawn = lambda c: draw(seed, c) < share
    near = e.groupBy("a").agg(F.bool_or(~drawn("b")).alias("kept"))  # the draw of an end is known from its name
    lonely = cut(near.where(~F.col("kept") & ~drawn("a")).select("a"))
    risky = cut(e.join(lonely, "a", "left_semi").select(F.col("b").alias("a")).distinct())
    pick = cut(near.where(drawn("a")).select("a").join(risky, "a", "left_anti"))
    hit = lambda c: t.where(drawn(c)).join(pick.select(F.col("a").alias(c)), c, "left_semi").select(*HRT)
    lost = cut(hit("h").unionByName(hit("t")).distinct())
    starve = lost.groupBy("r").agg(F.count("*").alias("x")).join(t.groupBy("r").agg(F.count("*").alias("n")), "r").where(F.col("n") - F.col("x") < min_triples).select("r")
    bad = lost.join(starve, "r", "left_semi")
    ends = bad.select(F.col("h").alias("a")).unionByName(bad.select(F.col("t").alias("a"))).distinct()
    return pick.join(ends, "a", "left_anti").select(F.col("a").alias("ent"))


def top_classes(types: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent classes: (cls, n)."""
    return types.groupBy("cls").agg(F.count_distinct("ent").alias("n")).orderBy(F.desc("n"), "cls").limit(k)
