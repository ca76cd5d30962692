"""From rule predictions to ranked completions: aggregation, filtering, top-k, ensembles.

Predictions are rows (task columns..., candidate, rule_id, confidence). Every ranking breaks
ties by the candidate, so results are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sets import HRT

EPSILON = 1e-4


def discriminating(p: DataFrame, task: list[str], bound: int = 1000) -> DataFrame:
    """Predictions without the rules that propose ``bound`` candidates or more for a task."""
    wide = p.groupBy(*task, "rule_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= bound).select(*task, "rule_id")
    return p.join(wide, [*task, "rule_id"], "left_anti")


def max_plus(p: DataFrame, task: list[str]) -> DataFrame:
    """Candidates by their descending list of confidences, compared lexicographically; score sums eps^i conf_i."""
    c = p.groupBy(*task, "candidate").agg(F.sort_array(F.collect_list("confidence"), asc=False).alias("confs"))
    s = F.aggregate("confs", F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("e")), lambda t, x: F.struct((t["s"] + t["e"] * x).alias("s"), (t["e"] * F.lit(EPSILON)).alias("e")), lambda t: t["s"])
    return c.withColumn("score", s)


def noisy_or(p: DataFrame, task: list[str]) -> DataFrame:
    """1 - prod(1 - conf) over the rules of a candidate."""
    return p.groupBy(*task, "candidate").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-12)))))).alias("score"))


def maximum(p: DataFrame, task: list[str]) -> DataFrame:
    """The best confidence, and the rule that gave it."""
    return p.groupBy(*task, "candidate").agg(F.max("confidence").alias("score"), F.max_by("rule_id", F.struct("confidence", -F.col("rule_id"))).alias("rule_id"))


def top(scored: DataFrame, task: list[str], k: int, by: str = "score", ascending: bool = False, item: str = "candidate") -> DataFrame:
    """The best k of each task with their rank. Spark limits each task's group before the shuffle."""
    w = Window.partitionBy(*task).orderBy(F.asc(by) if ascending else F.desc(by), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unknown(scored: DataFrame, known: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Candidates (h, r, t) that are not known triples; a task's own answers may stay."""
    k = known.select(*HRT).distinct()
    if answers is not None:
        k = k.join(answers.select(*HRT).distinct(), HRT, "left_anti")
    return scored.join(k, HRT, "left_anti")


def extend(a: DataFrame, b: DataFrame, task: list[str], factor: float = 1.0) -> DataFrame:
    """Ensemble: the better of a's score and ``factor`` times b's, over the candidates of either."""
    j = a.select(*task, "candidate", F.col("score").alias("_a")).join(b.select(*task, "candidate", (F.col("score") * factor).alias("_b")), [*task, "candidate"], "full_outer")
    return j.select(*task, "candidate", F.greatest("_a", "_b").alias("score"))


def reorder(a: DataFrame, b: DataFrame, task: list[str], alpha: float = 0.0, beta: float = 0.5) -> DataFrame:
    """a's candidates by a blend of both rankings: (1 + alpha) / (rank + alpha), weighted beta and 1 - beta."""
    place = lambda d, n: d.select(*task, "candidate", F.row_number().over(Window.partitionBy(*task).orderBy(F.desc("score"), "candidate")).alias(n))
    j = place(a, "_p").join(place(b, "_q"), [*task, "candidate"], "left")
    gain = lambda c: F.lit(1 + alpha) / (F.col(c) + alpha)
    return j.select(*task, "candidate", (beta * gain("_p") + (1 - beta) * F.coalesce(gain("_q"), F.lit(0.0))).alias("score"))


def produced(scored: DataFrame, known: DataFrame, truth: DataFrame, task: list[str], k: int = 10, slack: float = 5.0) -> DataFrame:
    """Top-k new candidates of each task; when the truth (task, candidate) is in the top k, only those within ``slack`` of its score."""
    best = top(scored, task, k)
    mark = best.join(truth.select(*task, "candidate").distinct().withColumn("_true", F.lit(True)), [*task, "candidate"], "left")
    limit = mark.where("_true").groupBy(*task).agg(F.min("score").alias("_s"))
    kept = mark.join(limit, task, "left").where(F.col("_s").isNull() | (F.col("score") >= F.col("_s") - slack))
    return kept.join(known.select(*task, "candidate").distinct(), [*task, "candidate"], "left_anti").select(*task, "candidate", "score", "rank")


def collapse(p: DataFrame) -> DataFrame:
    """One row a triple, with its highest score."""
    return p.groupBy(*HRT).agg(F.max("score").alias("score"))
