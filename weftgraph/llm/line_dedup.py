"""Line deduplication: lines that many documents share stay in one of them only.

Native DataFrame operators throughout. A narrow (line hash, document) table is counted
with map-side combine; only the hashes to drop meet the texts again, one shuffle of the
documents by their id. A line that a third of all documents hold is one group of narrow
rows that combines before the shuffle, and the join with the drop list is salted.

Edge cases: null or empty text is one empty line; rows that share a doc_id count as one
document; a row with a null doc_id is never counted and keeps its lines; very long texts are
worked on whole; extra columns pass through, but those named like a result of ``dedup_lines``, which it replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, cut, salted_join

MIN_CHARS, MIN_DOCS = 40, 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, drop): the digests of the lines that each document has to give up."""
    long_keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.char_length(k) >= min_chars))
    held = cut(docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.transform(long_keys, _digest)).alias("k")))
    hot = held.groupBy("k").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    gone = salted_join(held, hot.select("k", "keep"), ["k"], F.col("doc_id"), "inner").where("doc_id <> keep")
    return gone.groupBy("doc_id").agg(F.collect_set("k").alias("drop"))


def _kept(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with helper columns of fresh names, and the kept text, number of lines, and number dropped."""
    own, drop, all_, kept = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "drop", "all", "kept"))
    drops = repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias(own), F.col("drop").alias(drop))
    joined = docs.join(drops.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left")
    stay = F.filter(_lines(F.col("text")), lambda x: (F.char_length(x) < min_chars) | ~F.array_contains(F.col(drop), _digest(_key(x))))
    split = joined.withColumn(all_, F.size(_lines(F.col("text"))).cast("long")).withColumn(kept, F.when(F.col(drop).isNotNull(), stay))
    text = F.when(F.col(kept).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return split, text, F.col(all_), F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.col(all_) - F.size(kept)).cast("long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; other columns as they were."""
    df, text, lines, dropped = _kept(docs, min_chars, min_docs)
    results = {"kept_text": text, "n_lines": lines, "n_dropped": dropped}
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def dedup_texts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the kept text as ``text``; all other columns, whatever their names, as they were."""
    df, text, *_ = _kept(docs, min_chars, min_docs)
    return df.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
