"""Connected components of a table of links: labels spread along links and jump along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, label (least node that links reach) of each node of links (u, v).

    A round takes the least label among a node's neighbours, then the label of that label; the number of
    rounds is about the logarithm of the longest chain. Rounds meet in partial minima, and each is written
    to the shared folder, so a lost executor costs one round's tasks.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = space.keep(both, f"{name}-links", small=True)
    labels = space.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), f"{name}-0", small=True)
    at = 0
    while True:
        known = labels.select(F.col("node").alias("v"), F.col("label").alias("theirs"))
        near = both.join(known, "v").groupBy(F.col("u").alias("node")).agg(F.min("theirs").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("met"))
        jump = labels.select(F.col("node").alias("met"), F.col("label").alias("far"))
        moved = met.join(jump, "met", "left").select("node", F.least("met", F.coalesce("far", "met")).alias("label"), (F.least("met", F.coalesce("far", "met")) < F.col("label")).alias("moved"))
        following = space.keep(moved, f"{name}-{at + 1}", small=True)
        changed = following.filter("moved").limit(1).count()
        labels = following.select("node", "label")
        space.drop(f"{name}-{at}")
        at += 1
        if not changed:
            return labels
