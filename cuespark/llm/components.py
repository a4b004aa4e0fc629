"""Connected components of a link table, as DataFrame rounds.

Every round points each node at the smallest label among itself and its neighbours and then at that
label's own label (pointer jumping), so a chain of n links needs about log n rounds.  Each round is an
aggregation with a map-side minimum (a hub's links never gather in one task) and is written to the
shared folder, so a lost executor repeats one round.  The join of links with labels is an inner one, whose
skewed partitions (a hub's links) Spark splits.

Defined results: links of a node with itself and repeated links change nothing; direction does not matter;
nodes without links are not in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``node, label``: the smallest node reachable, for every node that has a link."""
    pairs = links.select("a", "b").where("a <> b")
    edges = stage(pairs.union(pairs.select("b", "a")).distinct())
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        # the old label learns of the smaller one too, so whole trees move at once
        hooks = best.where("best < label").groupBy(F.col("label").alias("node")).agg(F.min("best").alias("hook"))
        hooked = best.join(hooks, "node", "left").select("node", "label", F.least("best", F.coalesce("hook", "best")).alias("best"))
        hooked = stage(hooked)
        above = hooked.select(F.col("node").alias("best"), F.col("best").alias("up"))
        after = stage(hooked.join(above, "best", "left").select("node", "label", F.least("best", F.coalesce("up", "best")).alias("new")))
        if after.where("new <> label").isEmpty():
            return labels
        labels = after.select("node", F.col("new").alias("label"))
