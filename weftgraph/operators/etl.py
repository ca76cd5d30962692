"""Preparation of graphs from raw tables: names, sentences, redirects, id bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import HRT


def best_sentence(s: DataFrame, max_spaces: int = 64) -> DataFrame:
    """(h, r, t, sentence): the best-scored sentence of each triple, of at most ``max_spaces`` spaces."""
    short = s.where(F.length("sentence") - F.length(F.replace(F.col("sentence"), F.lit(" "), F.lit(""))) <= max_spaces)
    return short.groupBy(*HRT).agg(F.max_by("sentence", F.struct("score", "sentence")).alias("sentence"))


def entity_text(sentences: DataFrame) -> DataFrame:
    """(ent, text): the distinct sentences of an entity, joined in order."""
    e = sentences.select(F.col("h").alias("ent"), "sentence").unionByName(sentences.select(F.col("t").alias("ent"), "sentence"))
    return e.groupBy("ent").agg(F.array_join(F.array_sort(F.collect_set("sentence")), " ").alias("text"))


def split_names(ents: DataFrame) -> DataFrame:
    """``concept_type_name`` strings to (ent, cls, text)."""
    p = F.split("ent", "_", 3)
    return ents.select("ent", F.coalesce(F.get(p, F.lit(1)), F.lit("thing")).alias("cls"), F.regexp_replace(F.coalesce(F.get(p, F.lit(2)), F.get(p, F.lit(1)), F.get(p, F.lit(0))), "_", " ").alias("text"))


def append_type_text(texts: DataFrame, types: DataFrame) -> DataFrame:
    names = types.groupBy("ent").agg(F.array_join(F.array_sort(F.collect_set("cls")), ", ").alias("names"))
    return texts.join(names, "ent", "left").select("ent", F.concat_ws(" ", "text", "names").alias("text"))


def redirected(ents: DataFrame, texts: DataFrame, redirects: DataFrame) -> DataFrame:
    """(ent, text): an entity's own description, else that of the page it redirects to (the smallest title if several)."""
    own = ents.select("ent").distinct().join(texts.select("ent", "text"), "ent", "left")
    far = redirects.select("ent", "page").join(texts.select(F.col("ent").alias("page"), F.col("text").alias("far")), "page").groupBy("ent").agg(F.min_by("far", "page").alias("far"))
    return own.join(far, "ent", "left").select("ent", F.coalesce("text", "far").alias("text"))


def bridge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two vocabularies (name, id) to (id_a, id_b) by name."""
    return a.select("name", F.col("id").alias("id_a")).join(b.select("name", F.col("id").alias("id_b")), "name").select("id_a", "id_b")


def drop_inconsistent_types(scanned: DataFrame) -> DataFrame:
    """(ent, classes) of the valid rows of a type scan."""
    return scanned.where("is_valid").groupBy("ent").agg(F.array_sort(F.collect_set("cls")).alias("classes"))


def seen_in(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose head and tail both occur in training."""
    e = train.select(F.col("h").alias("e")).unionByName(train.select(F.col("t").alias("e"))).distinct()
    return test.join(e.withColumnRenamed("e", "h"), "h", "left_semi").join(e.withColumnRenamed("e", "t"), "t", "left_semi").select(*HRT)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the smallest in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def parse_reply(replies: DataFrame) -> DataFrame:
    """Language-model replies with lines ``name: 0.3`` to (id, candidate, score)."""
    line = r"(?m)^\s*(?:\d+[.)]\s*)?(.+?)\s*[:=]\s*([01](?:\.\d+)?)\s*$"
    m = replies.select("id", F.explode(F.regexp_extract_all("reply", F.lit(line), F.lit(0))).alias("m"))
    return m.select("id", F.regexp_extract("m", line, 1).alias("candidate"), F.regexp_extract("m", line, 2).cast("double").alias("score"))
