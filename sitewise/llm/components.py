"""Connected components by contraction, in DataFrame operations only.

Every round each vertex hooks to its smallest neighbour, edges are rewritten
to the hooked vertices and loops and repeats go.  Stars (a representative
with all its copies) collapse in the first round, and each round removes
every vertex that is not a local minimum, so the rounds are logarithmic.
The per-vertex minimum has a map-side partial aggregate, so a vertex with a
third of all edges is not collected anywhere, and its joins are inner joins
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, is_empty, materialise


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of ``edges``; component is the
    smallest id reachable.  Null ends and loops are ignored; an empty edge
    table gives an empty result."""
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"),
                     F.col(src).isNotNull().alias("s"), F.col(dst).isNotNull().alias("d"))
    e = materialise(e.where("s and d and a <> b").select("a", "b").distinct(), "cc-edges")
    labels = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("h")), "cc-hook")
        if labels is None:
            new = hook.select(F.col("a").alias("id"), F.col("h").alias("component"))
        else:
            new = (labels.join(hook, labels["component"] == hook["a"], "left")
                   .select("id", F.coalesce("h", "component").alias("component")))
        new = materialise(new, "cc-labels")
        ha = hook.select("a", F.col("h").alias("x"))
        hb = hook.select(F.col("a").alias("b"), F.col("h").alias("y"))
        nxt = e.join(ha, "a").join(hb, "b").where("x <> y")
        nxt = materialise(nxt.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                          .distinct(), "cc-edges")
        drop(*[t for t in (labels, hook, e) if t is not None])
        labels, e = new, nxt
        if is_empty(e):
            drop(e)
            return labels
