"""Evaluation: ranks, hits, reciprocal ranks, classification thresholds, coverage of producer rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import HRT


def ranks(scored: DataFrame, truth: DataFrame, known: DataFrame | None, task: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """Rank of each true candidate: one more than the candidates that score strictly higher; null where it was not scored.

    ``known`` (task, candidate) filters other true answers out; ``allowed`` (r, candidate)
    constrains candidates by type.
    """
    gold = truth.select(*task, F.col("candidate").alias("answer")).distinct()
    s = scored
    if allowed is not None:
        s = s.join(allowed.distinct(), ["r", "candidate"], "left_semi")
    mine = gold.join(scored.select(*task, F.col("candidate").alias("answer"), F.col("score").alias("_own")), [*task, "answer"])
    others = s.join(mine, task).where("candidate <> answer AND score > _own")
    if known is not None:
        others = others.join(known.select(*task, "candidate").distinct(), [*task, "candidate"], "left_anti")
    n = others.groupBy(*task, "answer").agg(F.count("*").alias("_n"))
    ranked = mine.join(n, [*task, "answer"], "left").select(*task, "answer", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("rank"))
    return gold.join(ranked, [*task, "answer"], "left")


def summary(r: DataFrame, ks: tuple[int, ...] = (1, 3, 10), by: list[str] | None = None) -> DataFrame:
    """Mean rank of what is ranked; mean reciprocal rank and hits at k of all rows, those without a rank as misses."""
    aggs = [F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mr"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    aggs += [F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6).alias(f"hits_{k}") for k in ks]
    return r.groupBy(*(by or [])).agg(*aggs)


def list_hits(top: DataFrame, gold: DataFrame, known: DataFrame, task: list[str], ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Hits and approximate MRR from ranked lists (task, candidate, rank) of at most 100; an answer that is not listed misses."""
    k = known.select(*task, "candidate").distinct().withColumn("_known", F.lit(1))
    g = gold.select(*task, "candidate").distinct().withColumn("_gold", F.lit(1))
    m = top.join(k, [*task, "candidate"], "left").join(g, [*task, "candidate"], "left")
    before = Window.partitionBy(*task).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.coalesce("_known", "_gold", F.lit(0))).over(before), F.lit(0))
    hit = m.withColumn("rank", F.col("rank") - ahead).where("_gold = 1").select(*task, "candidate", "rank")
    rows = g.drop("_gold").join(hit, [*task, "candidate"], "left")
    aggs = [F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank") <= 100, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")]
    return rows.agg(*aggs, *[F.round(F.avg(F.when(F.col("rank") <= x, 1.0).otherwise(0.0)), 6).alias(f"hits_{x}") for x in ks])


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 from columns ``actual`` and ``predicted`` (0 or 1)."""
    c = rows.groupBy(*(by or [])).agg(F.count_if(F.expr("actual = 1 AND predicted = 1")).alias("tp"), F.count_if(F.expr("actual = 0 AND predicted = 1")).alias("fp"), F.count_if(F.expr("actual = 1 AND predicted = 0")).alias("fn"), F.count_if(F.expr("actual = 0 AND predicted = 0")).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    z = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return c.withColumns({"precision": z(p), "recall": z(r), "f1": z(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))})


def best_threshold(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The score (and accuracy) that best parts actual 1 from 0, predicting 1 at the threshold or above.

    Counts per distinct score first, so the running sums are over scores, not rows.
    """
    by = by or []
    s = scored.groupBy(*by, "score").agg(F.count_if(F.expr("actual = 1")).alias("p"), F.count_if(F.expr("actual = 0")).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    r = s.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w)})
    total = s.groupBy(*by).agg(F.sum("p").alias("p_all"), F.sum("q").alias("q_all"))
    j = r.join(total, by) if by else r.crossJoin(F.broadcast(total))  # one row
    acc = (F.col("tp") + F.col("q_all") - F.col("fp")) / (F.col("p_all") + F.col("q_all"))
    return j.groupBy(*by).agg(F.max_by("score", F.struct(acc, "score")).alias("threshold"), F.round(F.max(acc), 6).alias("accuracy"))


def threshold_grid(scored: DataFrame, label: str, low: int, high: int, step: int) -> DataFrame:
    """Macro F1 over the labels for each threshold (in hundredths), for rows (label, score, actual)."""
    t = scored.withColumn("threshold", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    t = t.withColumn("predicted", (F.col("score") * 100 >= F.col("threshold")).cast("int"))
    return confusion(t, [label, "threshold"]).groupBy("threshold").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def ndcg(run: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """Per query (qid): nDCG at k of a run (qid, doc, rank) against gains (qid, doc, gain)."""
    disc = lambda c: 1 / F.log2(F.col(c) + 1)
    ideal = gains.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "doc"))).where(F.col("_i") <= k).groupBy("qid").agg(F.sum(F.col("gain") * disc("_i")).alias("_ideal"))
    got = run.where(F.col("rank") <= k).join(gains, ["qid", "doc"]).groupBy("qid").agg(F.sum(F.col("gain") * disc("rank")).alias("_got"))
    return ideal.join(got, "qid", "left").select("qid", F.round(F.coalesce(F.try_divide("_got", "_ideal"), F.lit(0.0)), 6).alias("ndcg"))


def rounds(blocks: DataFrame) -> DataFrame:
    """Correctness, consistency, coverage and their harmonic means of producer blocks (init, target, n, vc, cc).

    n: new rows of a block, vc: valid ones, cc: correct ones; ``init`` is the size before the first block.
    """
    hm = lambda a, b: F.round(F.coalesce(F.try_divide(2 * F.col(a) * F.col(b), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    a = blocks.agg(
        F.coalesce(F.avg(F.try_divide("cc", "n")), F.lit(0.0)).alias("correctness"), F.coalesce(F.avg(F.try_divide("vc", "n")), F.lit(0.0)).alias("consistency"),
        F.coalesce(F.try_divide(F.sum("cc"), F.min("init")), F.lit(0.0)).alias("coverage_c"), F.coalesce(F.try_divide(F.sum("vc"), F.min("init")), F.lit(0.0)).alias("coverage_v"),
    )
    r = lambda c: F.round(c, 6).alias(c)
    return a.select(r("correctness"), r("consistency"), r("coverage_c"), r("coverage_v"), hm("correctness", "coverage_c").alias("h_correctness"), hm("consistency", "coverage_v").alias("h_consistency"))


def hardness(test: DataFrame, train: DataFrame) -> DataFrame:
    """Expected hit@1 of guessing the most frequent tail of the relation."""
    freq = train.groupBy("r", "t").agg(F.count("*").alias("n"))
    best = freq.groupBy("r").agg(F.max_by("t", F.struct("n", "t")).alias("guess"))
    return test.join(best, "r", "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((F.col("t") == F.col("guess")).cast("double"), F.lit(0.0))), 6).alias("expected_hit"))


def compare_runs(a: DataFrame, b: DataFrame, task: list[str]) -> DataFrame:
    """Which of two rank tables (task, answer, rank) has the answer first, counted."""
    j = a.select(*task, "answer", F.col("rank").alias("_a")).join(b.select(*task, "answer", F.col("rank").alias("_b")), [*task, "answer"], "full_outer")
    x, y = F.coalesce("_a", F.lit(1 << 30)), F.coalesce("_b", F.lit(1 << 30))
    return j.agg(F.count_if(x < y).alias("a_first"), F.count_if(x > y).alias("b_first"), F.count_if(x == y).alias("even"))


def divergence(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """Kullback-Leibler divergence and Bhattacharyya coefficient of two count tables (key, n), with add-one smoothing."""
    j = p.select(key, F.col("n").alias("_p")).join(q.select(key, F.col("n").alias("_q")), key, "full_outer").select((F.coalesce("_p", F.lit(0)) + 1.0).alias("p"), (F.coalesce("_q", F.lit(0)) + 1.0).alias("q"))
    total = j.agg(F.sum("p").alias("p_all"), F.sum("q").alias("q_all"))
    x, y = F.col("p") / F.col("p_all"), F.col("q") / F.col("q_all")
    return j.crossJoin(F.broadcast(total)).agg(F.round(F.sum(x * F.log(x / y)), 6).alias("kl"), F.round(F.sum(F.sqrt(x * y)), 6).alias("bhattacharyya"))


def chao(sizes: DataFrame) -> DataFrame:
    """Chao's richness estimate from (seen) counts: d + f1^2 / (2 f2)."""
    a = sizes.agg(F.count("*").alias("d"), F.count_if(F.expr("seen = 1")).alias("f1"), F.count_if(F.expr("seen = 2")).alias("f2"))
    return a.select("d", F.round(F.col("d") + F.coalesce(F.try_divide(F.col("f1") * F.col("f1"), 2 * F.col("f2")), F.lit(0.0)), 6).alias("richness"))


def hard_cases(test: DataFrame, solved: DataFrame) -> DataFrame:
    return test.select(*HRT).join(solved.select(*HRT).distinct(), HRT, "left_anti")
