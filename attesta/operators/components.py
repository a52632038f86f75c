"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.staging import Staging


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges``; ``root`` is the smallest node reachable.

    Large-star and small-star rounds: every round replaces each node's links by links to the smallest
    neighbour, so chains shrink at least by half and hubs are never gathered (a hub's rows meet in a
    partial minimum and a join that can be split). Stops once a round changes nothing.

    Nulls and self links are ignored; an empty edge table gives an empty result.
    """
    stage = Staging(edges.sparkSession, "components")
    x, y = F.col(a), F.col(b)
    links = (
        edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    links, before = stage.put(links, "r0"), None
    for k in range(1, max_rounds + 1):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"m{k}")
        # every neighbour above a node moves to the smallest of its neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.put(large.where("u <> v").distinct(), f"l{k}")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # every neighbour below a node, and the node, move to the smallest below
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        links = stage.put(small, f"r{k}")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        stage.drop(f"l{k}", f"m{k}", f"r{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
