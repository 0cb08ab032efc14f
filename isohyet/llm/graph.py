"""Connected components of edge lists, by hooking and pointer jumping in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is its component's least node.

    Each round lets every node take the least root among its neighbours, hooks that
    onto its own root, and halves the paths. Rounds grow with the logarithm of a
    component's extent; a node with many neighbours is met by partial minima only.
    Edges with a null end and loops join nothing, and their ends are no nodes by them; repeated
    edges count once; no edges give no rows.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
    labels = written(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "other").alias("new"))
        # a root hooks onto the least new root that any of its nodes has seen
        hook = seen.groupBy("root").agg(F.min("new").alias("to")).where(F.col("to") < F.col("root"))
        hooked = seen.join(hook.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"), "left").select("node", "root", F.least("new", F.coalesce("to", "new")).alias("new"))
        step = written(hooked)
        jumped = step.join(step.select(F.col("node").alias("_node"), F.col("new").alias("up")), F.col("new") == F.col("_node"), "left")
        after = written(jumped.select("node", F.least("new", F.coalesce("up", "new")).alias("root"), F.col("root").alias("was")))
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels
