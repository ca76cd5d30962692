"""A corpus pipeline: toxicity filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes all that its predecessor kept; all but the last return the columns of their input, extra ones included,
whatever their names. Edge cases are those of the operators: null and empty texts pass all filters (line
dedup makes null texts empty); documents with a null doc_id are kept by every filter; rows that repeat a doc_id with one text are
one document; very long texts are worked on whole; empty tables give empty results at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontam, line_dedup, ngram_join, packing, toxicity
from weftgraph.llm.common import shared_folder, table
from weftgraph.llm.queries_python import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents of the stage's input, drop those that score 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.train_fold(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; ``n_chars``, where there is one, follows the text."""
    out = line_dedup.dedup_texts(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_duplicates), ("decontamination", drop_benchmark), ("packing", pack)]

#: SQL can't express the learned toxicity model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again.

    A stage's input is removed once its result is written; the last result stays, as it is what is returned.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
