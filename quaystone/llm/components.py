"""Connected components of a link table, by hooking to the smallest neighbour label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import stored


def connected(links: DataFrame, base: str, name: str) -> DataFrame:
    """links (a long, b long) to (node, label): label is the smallest node reachable. Nodes without links are not listed.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most. Nulls and
    self-links are ignored; an empty table gives an empty table.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    pairs = stored(pairs.union(pairs.select("b", "a")).distinct(), base, f"{name}-pairs")
    labels = stored(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.lit(True).alias("moved"), F.least("node", "m").alias("label")), base, f"{name}-0")
    step = 0
    while labels.filter("moved").limit(1).count():
        step += 1
        near = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = hooked.join(roots, "label").select("node", F.col("root") != F.col("old"), F.least("label", "root"))
        labels = stored(jumped.toDF("node", "moved", "label"), base, f"{name}-{step}")
    return labels.select("node", "label")
