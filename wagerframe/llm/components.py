"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagerframe.llm.shared import save


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = save(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")
    moved = edges.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b) but those least ones.

    Rounds go on until a round leaves the edges as they were; then each is a node
    and its component. Every round is written, and only its edge count and a sum
    of hashes reach the driver. Least neighbours are written before they are joined,
    so that the join deals out both sides and can split a node with most edges. Loops, repeats and nulls in the edges do no harm.
    """
    edges = save(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "component-edges",
    )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    now = mark(edges)
    while now[0]:
        edges = save(_small_star(_large_star(edges).distinct()).distinct(), "component-edges")
        before, now = now, mark(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
