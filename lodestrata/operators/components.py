"""Connected components of links, by repeated minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) of every node that has a link.

    Each round every node takes the least label among itself and its
    neighbours, then the label of its label, so chains halve, until none moves;
    labels only fall, so that comes about. Labels and links stay distributed; only the number of changes reaches the driver. Self
    links and repeated links do no harm; no links give an empty result.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null")
    both = cut_lineage(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "component": "seen"}), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(least.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
