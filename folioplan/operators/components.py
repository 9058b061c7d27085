"""Connected components over (item, key) pairs: items that share a key, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioplan.compat import cut


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """item, component (its smallest item); pairs: item, key.

    A key of any number of items costs a partial aggregate; labels spread item -> key -> item and jump to the label of
    their label, so a chain of n items needs about log n rounds.
    """
    pairs = cut(pairs.where("key IS NOT NULL").select("item", "key").distinct())
    labels = pairs.select("item").distinct().withColumn("label", F.col("item"))
    for _ in range(max_rounds):
        by_key = pairs.join(labels, "item").groupBy("key").agg(F.min("label").alias("label"))
        near = pairs.join(by_key, "key").groupBy("item").agg(F.min("label").alias("label"))
        jump = near.select(F.col("item").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(jump, "label", "left").select("item", F.least("label", "further").alias("label")).join(labels.withColumnRenamed("label", "old"), "item"))
        labels = new.select("item", "label")
        if not new.where("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle in the rounds allowed")
