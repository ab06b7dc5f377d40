"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (id, component), component the least id that is reachable. Every id of a link is there.

    A round takes the least label among an id, its neighbours, and its label's own label; rounds end when nothing
    changes. All is joined and grouped by id; aggregates are partial, so a hub with many links is pre-aggregated.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = cut(label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")), "labels")
        up = new.select(F.col("id").alias("component"), F.col("component").alias("top"))
        jumped = cut(new.join(up, "component", "left").select("id", "old", F.least("component", "top").alias("component")), "labels")
        if jumped.where("component <> old").isEmpty():
            forget(both, label, new)
            return jumped.select("id", "component")
        forget(label, new)
        label = jumped.select("id", "component")
