"""Positions in a total order of all rows, without a window over all rows in one task.

Rows are range-partitioned by the order and sorted inside their partitions; a row's global position is its
place in the partition plus the rows of the partitions before, and so for running sums.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, ship_package


def _running(batches):
    """Per partition: rows and sizes before each row, in the order the rows come."""
    import numpy as np
    rows = total = 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        upto = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.arange(rows, rows + len(size))), pa.array(upto - size)],
            names=[*batch.schema.names, "local_row", "local_start"])
        rows += len(size)
        total = int(upto[-1]) if len(size) else total


def running_totals(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (a written table with a ``long`` column ``size``) with ``position``, the number of rows before,
    and ``start``, the sum of their sizes, in ``order``. End the order with a column that tells all rows
    apart: then a key that repeats on any share of the rows spreads over partitions like the rest.

    The sorted partitions are written once; one row per partition (rows and size) is then summed up, so the
    only window that spans everything has as many rows as there are partitions. An empty table stays empty.
    """
    ship_package(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = cut_lineage(
        dealt.mapInArrow(_running, f"{fields}, local_row long, local_start long")
        .withColumn("part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    # one row per partition of the shuffle: its size is the partition count, whatever the table's
    return local.join(F.broadcast(offsets), "part").select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("local_row") + F.col("rows_before")).alias("position"),
        (F.col("local_start") + F.col("bytes_before")).alias("start"))
