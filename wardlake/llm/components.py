"""Connected components of a link table.

Each round, a node takes the smallest label among its neighbours' and its own; then
labels are followed one step further (pointer jumping), so long chains shrink by halves.
Label tables are written to the shared folder each round. Minima are taken before rows
move. Links to a node with very many of them get its label by broadcast, and so does what
points to a label that changed, as long as these tables are small; so neither a hub nor a
large component gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import durable, joinable, rows

# Links from which a node is a hub. There are at most 2 / HUB hubs a link.
HUB = 256
# Rows that a part of a written table holds, and the fewest parts: each round writes several
# tables, so parts follow the number of links and not that of the cluster's shuffles.
PART_ROWS = 50_000
LEAST_PARTS = 8


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b) links; the component is its smallest node.

    `links` is read twice: pass a written table.
    """
    parts = max(LEAST_PARTS, rows(2 * links.count(), PART_ROWS))

    def kept(table: DataFrame) -> DataFrame:
        return durable(table.coalesce(parts))

    both = kept(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    )
    nodes = kept(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree")))
    hubs = kept(nodes.where(F.col("degree") >= HUB).select(F.col("a").alias("hub")))
    some = not hubs.isEmpty()
    if some:
        both = kept(both.join(joinable(hubs), both.b == hubs.hub, "left"))
    labels = kept(nodes.select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        plain = both.where("hub is null") if some else both
        offered = plain.join(labels, plain.b == labels.node).groupBy("a").agg(F.min("component").alias("offer"))
        if some:
            known = kept(hubs.join(labels, hubs.hub == labels.node).select("hub", "component"))
            told = both.where("hub is not null").join(joinable(known), "hub").groupBy("a").agg(F.min("component").alias("offer"))
            offered = offered.unionByName(told).groupBy("a").agg(F.min("offer").alias("offer"))
        offered = offered.withColumnRenamed("a", "node")
        # The root of a component learns of smaller labels through its members as well.
        root = offered.join(labels, "node").groupBy("component").agg(F.min("offer").alias("offer"))
        root = root.select(F.col("component").alias("node"), "offer")
        best = offered.unionByName(root).groupBy("node").agg(F.min("offer").alias("offer"))
        stepped = kept(
            labels.join(best, "node").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        )
        if stepped.where("component <> was").isEmpty():
            return labels
        # Only labels that are no end themselves lead further.
        used = stepped.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "label")
        ends = stepped.join(used, stepped.node == used.label).where("component <> node")
        ends = kept(ends.select(F.col("node").alias("component"), F.col("component").alias("end")))
        labels = kept(
            stepped.join(joinable(ends), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        )
