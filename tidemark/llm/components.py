"""Connected components of an edge table, by rounds of joins; no component visits one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def led_to_roots(hooks: DataFrame) -> DataFrame:
    """``a``, ``up`` where ``up`` is the end of the chain that begins at ``a``.

    Every look-up doubles the way, so a chain of n takes log2(n) of them. Chains end because
    ``up`` is never larger than ``a``.
    """
    hooks = stored(hooks, "hooks")
    while True:
        above = hooks.filter("up != a").select(F.col("a").alias("via"), F.col("up").alias("above"))
        further = hooks.join(above, F.col("up") == F.col("via"), "left")
        hooks = stored(
            further.select("a", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "hooks"
        )
        settled = hooks.filter("moved").isEmpty()
        hooks = hooks.drop("moved")
        if settled:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every end of an edge (a, b).

    Each round hooks every label to the smallest label it meets, follows the hooks to their
    ends and leads the edges there. A label that still has an edge is hooked or has another
    hooked to it, so at least half of them go in a round. Edges inside one label leave. Tables
    are written, so that their sizes are known and lost executors cost no more than a round.
    Only whether rows are left reaches the driver.
    """
    rest = stored(edges.filter("a != b").select("a", "b").distinct(), "edges")
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("component")), "labels")
    while not rest.isEmpty():
        ends = rest.select("a", "b").union(rest.select("b", "a"))
        hooks = led_to_roots(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")))
        labels = stored(
            labels.join(hooks, labels["component"] == hooks["a"], "left").select(
                "node", F.coalesce("up", "component").alias("component")
            ),
            "labels",
        )
        one = hooks.select("a", F.col("up").alias("x"))
        two = hooks.select(F.col("a").alias("b"), F.col("up").alias("y"))
        led = rest.join(one, "a").join(two, "b").filter("x != y")
        rest = stored(led.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return labels
