"""Connected components of a link table, without a task or driver that holds the graph.

Rounds of two joins over the shrinking set of links between component labels: every label hooks onto the
smallest label next to it, chains are shortened by following the hook once more, and the links are renamed
and made distinct. A round at least halves the labels that still have links; tables between rounds are
written to the shared folder. Star-shaped and hot vertices cost only pre-aggregated minima; the joins are of
plain tables, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._store import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each vertex of ``links`` (two long columns; order, repeats and loops don't matter): node, component
    (the smallest vertex it reaches). Null ends are ignored; an empty table gives an empty result."""
    live = links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    live = materialise(live, "links")
    hooks: list[DataFrame] = []
    while live.take(1):
        # Each label's smallest neighbour or itself. Labels only fall, so the hooks are a forest.
        ends = live.select(F.col("y").alias("node"), F.col("x").alias("to")).unionByName(live.select(F.col("x").alias("node"), F.col("x").alias("to")))
        hook = materialise(ends.groupBy("node").agg(F.min("to").alias("to")), "hooks")
        for _ in range(2):  # follow the hooks: chains become a quarter as long
            far = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = materialise(hook.join(far, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "hooks")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("x"), F.col("to").alias("x2"))
        right = hook.select(F.col("node").alias("y"), F.col("to").alias("y2"))
        renamed = live.join(left, "x").join(right, "y").select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")).where("x <> y").distinct()
        # A label that hooked onto one that hooked further still belongs to the chain's end.
        open_chain = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").where("next <> to").select(F.least("to", "next").alias("x"), F.greatest("to", "next").alias("y")).distinct()
        live = materialise(renamed.unionByName(open_chain).distinct(), "links")
    if not hooks:
        return live.select(F.col("x").alias("node"), F.col("y").alias("component"))
    out = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = hook.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return out.select("node", F.col("to").alias("component"))
