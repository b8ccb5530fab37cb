"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node of its component.

    Each round takes the least root among neighbours and then the root of that root, so a component of any shape needs
    about as many rounds as the logarithm of its length. Minima are combined before they move. Every round is stored,
    so a plan never holds more than one of them.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least")).select(
        "node", F.least("node", "least").alias("root"))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select(
            "node", "root", F.least("root", "near").alias("next"))
        ahead = hooked.select(F.col("node").alias("next_node"), F.col("next").alias("ahead"))
        moved = stored(hooked.join(ahead, hooked["next"] == ahead["next_node"]).select("node", "root", "ahead"))
        labels = moved.select("node", F.col("ahead").alias("root"))
        if moved.filter("root <> ahead").isEmpty():
            return labels
