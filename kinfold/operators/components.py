"""Connected components of links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.storage import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component) for every id that has a link; the component is the smallest id reached.

    Smallest labels spread along links, and each label is then replaced by its own label, so the number of rounds grows
    with the logarithm of a component's width. Each round is written, and replaces the one before; the loop ends when
    nothing changes."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = stored(step.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        dropped(labels)
        labels = step.select("id", "component")
        if step.where("component < was").isEmpty():
            dropped(both)
            return labels
