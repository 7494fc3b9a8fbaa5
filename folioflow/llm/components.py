"""Connected components of a link table by repeated contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the links (a, b): nodes have one label if a path joins them.

    Each round maps every node to the neighbour (or itself) with the smallest hash and replaces links by links
    between these, which leaves a fraction of the nodes. Smallest neighbours are found with a
    combining aggregate, so a node with very many links is no special case. Links and maps are
    written out each round; nothing is collected but a count. ``label`` is one of the nodes.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").distinct(), "links")
    maps: list[DataFrame] = []
    while edges.count():
        if len(maps) == rounds:
            raise RuntimeError(f"links are not contracted after {rounds} rounds")
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        to = written(
            both.groupBy("a")
            .agg(F.min(ranked("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(F.col("m"), ranked("a"))["id"].alias("label")),
            "map",
        )
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("label").alias("_a"))
        right = to.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        edges = written(
            edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            .filter("a != b").distinct(),
            "links",
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        labels = labels.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    return labels
