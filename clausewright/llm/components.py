"""Connected components of a graph whose links are rows of a table.

Every node starts as its own label. A round gives each node the least label among
its own and its neighbours', then follows labels of labels (pointer jumping), so the
number of rounds grows with the logarithm of the longest path. Each round's labels
are a durable table; nothing but a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.durable import discard, durable


def connected_components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """node, label for every node that occurs in links (a, b); the label is the
    component's least node. Repeated links, links in one direction only and links of
    a node with itself are fine. n_links: rows of links, if they are known."""
    spark = links.sparkSession
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    edges = durable(both.distinct(), "edges", n_links and 2 * n_links)
    reads = 2 * edges.count()  # edges and at most as many labels
    labels = durable(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels", reads)
    while True:
        told = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        nearest = edges.join(told, "other").groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(nearest, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
        following = durable(hooked.join(jump, "new", "left").select("node", "label", F.least("new", "beyond").alias("next")), "labels", reads)
        changed = following.filter("label <> next").limit(1).count()
        discard(spark, labels)
        labels = following.select("node", F.col("next").alias("label"))
        if not changed:
            discard(spark, edges)
            return labels
