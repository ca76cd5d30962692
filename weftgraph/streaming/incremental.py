"""Scanning a stream of new triples against an accepted graph, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import HRT, Graph
from ..plans.checkpoints import mark, release_since
from ..plans.scan import scan_relations


def scan_stream(stream: DataFrame, g: Callable[[], Graph], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that scans every micro-batch of (h, r, t).

    ``g`` gives the accepted graph at the time of the batch; ``write`` gets the batch's rows
    (h, r, t, is_valid, pattern) and its number, and must be idempotent in that number, since a
    batch may be delivered again after a failure.
    """

    def batch(new: DataFrame, number: int) -> None:
        now, at = g(), mark()
        rows = Graph(now.triples.select(*HRT).unionByName(new.select(*HRT)), now.types, now.triples, now.patterns)
        write(scan_relations(rows).where("is_new").select(*HRT, "is_valid", "pattern"), number)
        release_since(new.sparkSession, at)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relation_rates(events: DataFrame, at: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Triples a window and relation, of a stream with an event time; windows close after ``late``."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "r").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "r", "n")
