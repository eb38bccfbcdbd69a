"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import checkpointed

MAX_ROUNDS = 60


def spanning_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links a-b and the smallest vertex each reaches; in memory, by minimum hooking and jumping."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return names, names[root]
        root = new


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component): for each vertex of ``links``, the smallest vertex it can reach.

    Alternating large and small stars: each round points every vertex at the least of its neighbours, first among the
    larger ones, then among the smaller. Minima are pre-aggregated, checkpointed and joined back, so that the join may split
    a vertex with very many links. Each round is cut by reliable checkpoints; there are about log(n) rounds. Self-links only name
    their vertex; null ends are ignored; no links give no rows.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    # each row points from a larger vertex to a smaller one, or at itself
    edges = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min(F.least("v", "u")).alias("m")))
        large = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == signature:
            break
        signature = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("component"))
