"""Global numbering of rows without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize


def number_rows(rows: DataFrame, order: list[str], name: str, within: str | None = None) -> DataFrame:
    """``rows`` plus ``name``: their place from 0 in ``order``, or in each value of ``within`` (the first of ``order``).

    The rows are range partitioned; each partition counts its own rows and adds
    those of the partitions before it. Rows equal in ``order`` are numbered
    in no particular order. The groups of ``within`` are few (levels).
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__line", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")  # both uses below must see the same partitions
    base = ranged.groupBy("__part").agg(F.count("*").alias("__rows"), F.min("__line").alias("__first"))
    # One row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    numbered = ranged.join(F.broadcast(base), "__part").withColumn(name, F.col("__offset") + F.col("__line") - F.col("__first"))
    if within is not None:
        start = numbered.groupBy(F.col(within).alias("__group")).agg(F.min(name).alias("__start"))
        numbered = numbered.join(F.broadcast(start), F.col(within).eqNullSafe(F.col("__group")))
        numbered = numbered.withColumn(name, F.col(name) - F.col("__start"))
    return numbered.select(*rows.columns, name)
