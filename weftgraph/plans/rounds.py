"""Producer rounds: derive candidates, keep what is new, check it, merge it, report, repeat.

A producer is a function ``(Graph) -> (triples, types)`` of candidate DataFrames. The three
stock producers apply mined rules, materialise an ontology, and complete with embeddings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import HRT, Graph
from ..operators import closure, ranking, rules
from ..operators.sets import difference
from . import scan
from .checkpoints import cut

Producer = Callable[[Graph], tuple[DataFrame, DataFrame | None]]


@dataclass
class Report:
    """Sizes of one block: graph before it, new rows, valid ones, correct ones."""

    producer: str
    before: int
    new: int
    valid: int
    correct: int


def run_block(g: Graph, name: str, produce: Producer, check: bool = True, domain: DataFrame | None = None, range_: DataFrame | None = None) -> tuple[Graph, Report]:
    """One block over the accepted graph ``g.triples``; returns the grown graph and its report.

    With ``check`` only valid rows are merged; without, every new row counts as valid and correct.
    """
    before = g.triples.count()
    made, types = produce(g)
    new = cut(difference(made.select(*HRT).distinct(), g.triples))
    n = new.count()
    if check and n:
        both = Graph(g.triples.select(*HRT).unionByName(new), g.types, g.triples, g.patterns)
        rows = scan.scan_relations(both).where("is_new").select(*HRT, "is_valid")
        rows = cut(scan.scan_schema(rows, g.types, domain, range_))
        v, c = rows.agg(F.count_if("is_valid"), F.count_if("correct")).first()
        new = rows.where("is_valid").select(*HRT)
    else:
        v = c = n
    merged = cut(g.triples.select(*HRT).unionByName(new).distinct())
    known = g.types
    if types is not None:
        ents = known.select("ent").distinct()
        known = cut(known.select("ent", "cls").unionByName(types.join(ents, "ent", "left_semi").select("ent", "cls")).distinct())
    return Graph(merged, known, None, g.patterns), Report(name, before, n, v, c)


def run(g: Graph, producers: dict[str, Producer], rounds: int = 1, check: dict[str, bool] | None = None, domain: DataFrame | None = None, range_: DataFrame | None = None) -> tuple[Graph, list[Report]]:
    """The producers in order, ``rounds`` times; stops when a whole round adds nothing."""
    reports: list[Report] = []
    for _ in range(rounds):
        grew = 0
        for name, p in producers.items():
            g, r = run_block(g, name, p, (check or {}).get(name, True), domain, range_)
            reports.append(r)
            grew += r.new
        if not grew:
            break
    return g, reports


def by_rules(min_confidence: float = 0.3, top: int = 10) -> Producer:
    """Mine two-atom rules, apply them, keep the best candidates of each (h, r)."""

    def produce(g: Graph) -> tuple[DataFrame, None]:
        mined = rules.mine_cyclic2(g.triples).withColumn("confidence", rules.applied_confidence(F.col("predicted"), F.col("correct"))).where(F.col("confidence") >= min_confidence)
        mined = cut(mined.withColumn("rule_id", F.xxhash64("head", "r1", "d1", "r2", "d2")))
        p = rules.predict_cyclic2(g.triples, mined).withColumnRenamed("t", "candidate")
        best = ranking.top(ranking.noisy_or(p, ["h", "r"]), ["h", "r"], top)
        return best.select("h", "r", F.col("candidate").alias("t")), None

    return produce


def by_ontology(axioms: DataFrame) -> Producer:
    """Materialise triples and types. Its block is usually run without a check."""
    return lambda g: (closure.triple_closure(g.triples, axioms), closure.type_closure(g.types, g.triples, axioms))


def by_scores(score: Callable[[Graph], DataFrame], k: int = 10) -> Producer:
    """``score`` gives (h, r, candidate, score) for the graph; the top k of each (h, r) are candidates."""
    return lambda g: (ranking.top(score(g), ["h", "r"], k).select("h", "r", F.col("candidate").alias("t")), None)
