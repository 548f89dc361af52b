"""Follow successor links from given roots, one chain per root, by doubling.

Each round appends as many links to every chain as it already has, and replaces each link
by the link of its link. A chain of n nodes takes log2(n) rounds of equi-joins on
(key, node), so a single long chain is spread over the cluster like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.session import cut_lineage


def follow(
    links: DataFrame, roots: DataFrame, keys: list[str], node: list[str], successor: list[str]
) -> DataFrame:
    """Nodes on the chains that start at ``roots`` (roots included).

    ``links`` has one row per (keys, node) with its successor; a node without a row ends
    the chain. Chains must not return to an earlier node; ``links`` must be cheap to read.
    """
    ids = [*keys, *node]
    hop = cut_lineage(links.select(*ids, *successor))
    visited = cut_lineage(roots.select(*ids))
    while True:
        reached = cut_lineage(
            visited.join(hop, ids).select(*keys, *[F.col(s).alias(n) for n, s in zip(node, successor)])
        )
        if reached.isEmpty():
            return visited
        visited = visited.unionByName(reached)
        far = hop.select(
            *keys,
            *[F.col(n).alias(s) for n, s in zip(node, successor)],
            *[F.col(s).alias(f"_far_{s}") for s in successor],
        )
        hop = cut_lineage(
            hop.join(far, [*keys, *successor]).select(
                *ids, *[F.col(f"_far_{s}").alias(s) for s in successor]
            )
        )
