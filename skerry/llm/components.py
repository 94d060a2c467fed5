"""Connected components of a link table, by label propagation with shortcuts.

Every round takes the least label among a node and its neighbours, then the
label of that label.  The work of a round is one join on nodes and one on
labels; a label that very many nodes share is a skewed join key, which adaptive
execution splits.  Each round is written to the shared folder, so lineage stays
short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        least = written(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component")), "labels")
        parent = least.select(F.col("node").alias("component"), F.col("component").alias("c"))
        after = written(least.join(parent, "component").select("node", "old", F.col("c").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where(F.col("old") != F.col("component")).isEmpty():
            return labels
