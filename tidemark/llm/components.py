"""Connected components of a link table by minimum labels with pointer jumping, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.store import keep


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node reachable.

    Each round takes the least label among a node's neighbours, then the label of that label; rounds grow with the
    logarithm of a star-like component's depth. Labels are written after each round, so lineage stays short. Hot nodes
    only meet in joins whose skewed partitions Spark splits, and in sums that are combined before the shuffle. Null
    ends and self links are ignored; an empty table gives an empty result.
    """
    links = links.dropna().filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = keep(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = links.join(labels, links["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = keep(nearer.join(up, "label", "left").select("node", "was", F.least("label", "above").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels
