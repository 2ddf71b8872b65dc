"""Connected components of a link table, by smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (``a, b``): the smallest id reachable.

    Every round each id takes the smallest label among its own and its neighbours', then
    its label's label, so labels travel twice as far from round to round. Only counts come to
    the driver; a hot id is met by a map-side combined minimum.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        step = step.join(jump, "next").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved"))
        step = stage(step, "labels")
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            return labels
