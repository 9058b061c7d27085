"""Row numbers where one group, or the whole table, may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import cut, partitions


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, most: int = 1_000_000) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... within each group of ``by`` (none: of the whole table) in ``order``, which must be total.

    Groups of up to ``most`` rows are numbered by one window.  Where a group is larger the rows are range-partitioned by
    group and order, numbered within each part, and moved on by the rows of the parts before: no task sorts more than
    its part, and the only thing ordered in one place is a row per part.  Both ways give the same numbers.
    """
    df = cut(df)
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    parts = max(partitions(df.sparkSession), -(-df.count() // most))
    keys = [F.col(c) for c in by]
    # The part is fixed by a checkpoint: a task that is run again must not see other boundaries.
    ranged = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", *by, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in by], "_before")
    done = ranged.withColumn(name, own).join(offsets, same).withColumn(name, (F.col(name) + F.col("_before")).cast("int"))
    return done.select(*df.columns, name)
