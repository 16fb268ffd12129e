"""Connected components by large-star and small-star steps, with written tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (id, component_id), component_id the smallest id reachable.

    Alternates the large-star and small-star steps, which end in one star per component. Each step is a
    minimum per vertex (combined map-side) joined back to the edges; both sides of the join are written
    tables or plain exchanges, so that Spark can split a hub's edges. Raises if it has not settled
    after ``max_rounds``. Self-links and nulls are ignored; an empty input gives no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m")), "low")
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = written(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def min_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) for ``nodes(id)`` and undirected ``links(a, b)``: label is the smallest id reachable. Ids may be structs."""
    stars = components(links.select("a", "b"))
    return nodes.select("id").distinct().join(stars, "id", "left").select("id", F.coalesce("component_id", "id").alias("label"))
