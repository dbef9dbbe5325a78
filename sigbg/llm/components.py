"""Connected components over link tables by hooking, shortcutting and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links(a, b)``; comp is one node of the component.

    Each pass hooks every node to its smallest neighbour, jumps twice and
    contracts the links; nodes of a component at least halve, so the passes
    grow with the logarithm of its size.  Everything stays in tables.
    """
    edges = write_through(links.filter("a <> b").select("a", "b").distinct(), "cc-links")
    comp = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")) \
            .select("node", F.least("node", "low").alias("to"))
        hook = write_through(hook, "cc-hook")
        up = hook.select(F.col("node").alias("to"), F.col("to").alias("top"))
        jump = write_through(hook.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("top")), "cc-jump")
        if comp is None:
            comp = jump.select("node", F.col("top").alias("comp"))
        else:
            comp = comp.join(jump.select(F.col("node").alias("comp"), "top"), "comp", "left") \
                .select("node", F.coalesce("top", "comp").alias("comp"))
        comp = write_through(comp, "cc-comp")
        a = jump.select(F.col("node").alias("a"), F.col("top").alias("ta"))
        b = jump.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        edges = write_through(edges.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
                              .filter("a <> b").distinct(), "cc-links")
    if comp is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    return comp
