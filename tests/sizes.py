"""What a query's plan moved: rows over its shuffles and rows out of its joins, after it ran."""

from __future__ import annotations


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    yield name, plan
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    elif name != "ReusedExchangeExec":
        for i in range(plan.children().size()):
            yield from _nodes(plan.children().apply(i))


def moved(df) -> tuple[int, int]:
    """(rows written to shuffles, most rows out of one join) of ``df``, which is run."""
    df.collect()
    shuffled, joined = 0, 0
    for name, node in _nodes(df._jdf.queryExecution().executedPlan()):
        value = lambda m: node.metrics().apply(m).value() if node.metrics().contains(m) else 0  # noqa: E731, B023
        if name == "ShuffleExchangeExec":
            shuffled += value("shuffleRecordsWritten")
        elif "Join" in name:
            joined = max(joined, value("numOutputRows"))
    return shuffled, joined
