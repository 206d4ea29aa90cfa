"""Positions in a global order, without one task sorting everything.

``row_number`` over a whole table or over one hot series runs in a single task.
Here rows are range-partitioned by the order itself, which splits a hot series
at any point, the partition number is frozen with a reliable checkpoint (range
bounds are sampled, so they must not be computed twice), and a position is the
rows before the partition plus the place inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.session import shared_folder


def with_position(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0, per key) and ``n_rows`` (rows of the key).

    ``keys + order`` must be unique per row for a deterministic result.
    """
    shared_folder(df.sparkSession)
    parts = (
        df.repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    # One row per key and partition: a key spans several partitions only if it is large.
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    ordered = W.partitionBy(*keys).orderBy("_part")
    offsets = sizes.withColumns(
        {
            "_before": F.sum("_size").over(ordered) - F.col("_size"),
            "n_rows": F.sum("_size").over(W.partitionBy(*keys)),
        }
    ).drop("_size")
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    placed = parts.withColumn("_place", F.row_number().over(inside) - 1)
    return (
        placed.join(offsets, [*keys, "_part"])
        .withColumn("pos", F.col("_before") + F.col("_place"))
        .drop("_part", "_place", "_before")
    )
