"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import checkpointed


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    Each round gives a node the smallest label among its neighbours, then that label's own label, so the rounds grow
    with the logarithm of the longest chain. Labels are checkpointed in the shared folder after each round. ``links`` is
    evaluated once for both directions: a plan that gives other (equally good) links each time would else leave links
    that lead one way only, along which no label comes back.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = checkpointed(links.where("a <> b").select(ways.alias("way")).select("way.a", "way.b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        better = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        stepped = checkpointed(better.join(jump, F.col("next") == F.col("at"), "left").select("node", "root", F.least("next", "beyond").alias("next")))
        labels = stepped.select("node", F.col("next").alias("root"))
        if stepped.where("root <> next").isEmpty():
            return labels
    raise RuntimeError(f"links not settled after {max_rounds} rounds")
