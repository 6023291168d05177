"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (a, b): label is the least node
    of its component.

    Each round every node takes the least node it is linked with and then that
    node's choice; links are rewritten to the choices, and those within one
    choice go. So links shrink, and rounds grow with the logarithm of a path.
    Minima are combined before they are shuffled; a hub is no hot spot."""
    edges = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    whole = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        choice = stored(ends.groupBy("node").agg(F.min("to").alias("label")), "choices")
        after = choice.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        choice = stored(choice.join(after, F.col("label") == F.col("_n")).select("node", F.col("_l").alias("label")), "choices")
        after = choice.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        if whole is None:
            whole = choice
        else:
            whole = stored(whole.join(after, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")), "labels")
        left = edges.join(after, F.col("a") == F.col("_n")).select(F.col("_l").alias("a"), "b")
        both = left.join(after, F.col("b") == F.col("_n")).select("a", F.col("_l").alias("b")).where("a != b")
        edges = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return whole
