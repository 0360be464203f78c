"""Connected components of a table of links, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every id in the columns a and b of links.

    Each round takes the least label among neighbours and then that label's own label, so long chains fold up quickly;
    rounds end when nothing changes. Links and labels stay distributed.
    """
    both = staged(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    label = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    old = label
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        up = label.select(F.col("id").alias("low"), F.col("component").alias("over"))
        new = staged(low.join(up, "low", "left").select("id", "old", F.least("low", F.coalesce("over", "low")).alias("component")), "labels")
        done = new.filter("component != old").isEmpty()
        discard(label if hasattr(label, "staged_path") else old)
        old, label = new, new.select("id", "component")
        if done:
            discard(both)
            return label
