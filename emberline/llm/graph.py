"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.sources.writers import stored

#: Links whose nodes a join may collect for a broadcast.
COLLECTED = 1 << 17


def _side(df: DataFrame, links: int) -> DataFrame:
    """``df``, a row a node of so many links, as a side to join with. Spark
    takes a table for as large as its files, of which the rows that are
    collected are many times the size; so many of them are merged instead."""
    return df if links <= COLLECTED else df.hint("merge")


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); the component is the
    smallest node that can be reached. Nulls link nothing.

    In each round every node hooks onto the node of the smallest hash within two
    links and follows the hooks twice; links between different groups are
    carried over to the groups. The hash is another one
    every round, so a long chain shrinks by a constant share however its nodes
    are numbered. A node with many links is pre-aggregated before it moves.
    Tables are written between rounds, and only how many links are left comes
    back to the driver. The result is a table, too, so that what is made of it
    has a short plan.
    """
    edges = stored(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "node_links")
    count = edges.count()
    steps: list[tuple[DataFrame, int]] = []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))

        def ranked(node: str):
            return F.struct(F.xxhash64(F.lit(len(steps)), node).alias("h"), F.col(node).alias("node"))

        near = both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        near = near.select(F.col("a").alias("b"), F.least("m", ranked("a")).alias("low"))
        # The neighbours' lowest reach one link further, so all ends of a star meet at once.
        step = both.join(_side(near, count), "b").groupBy("a").agg(F.min("low").alias("m")).select(F.col("a").alias("at"), F.col("m.node").alias("to"))
        # Followed from a table: each time doubles the plan, which the driver holds and keeps.
        step = stored(step, "first_hooks")
        for _ in range(2):
            further = step.select(F.col("at").alias("via"), F.col("to").alias("next"))
            step = step.join(_side(further, count), F.col("to") == F.col("via")).select("at", F.col("next").alias("to"))
        step = stored(step, "hooks")
        steps.append((step, count))
        a = step.select(F.col("at").alias("a"), F.col("to").alias("x"))
        b = step.select(F.col("at").alias("b"), F.col("to").alias("y"))
        moved = edges.join(_side(a, count), "a").where("x is not null").join(_side(b, count), "b").where("x <> y")
        edges = stored(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "group_links")
        count = edges.count()
        if not count:
            break
    found, first = steps[0]
    for step, count in steps[1:]:
        later = step.select(F.col("at").alias("via"), F.col("to").alias("next"))
        found = found.join(_side(later, count), F.col("to") == F.col("via"), "left").select("at", F.coalesce("next", "to").alias("to"))
    least = found.groupBy("to").agg(F.min("at").alias("component"))
    return stored(found.join(_side(least, first), "to").select(F.col("at").alias("node"), "component"), "components")
