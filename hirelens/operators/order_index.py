"""A two-level index of an order: rows numbered exactly, pages read by seeking.

Rows are range-partitioned on the order and sorted within partitions. They are stored with their place in their partition, a folder a
partition; beside them a table of fences: each partition's rows and the number of its first one. A row's number is its
fence's plus its place; the rows of some numbers lie in the few folders whose fences they meet, and only these are read.
No partition is listed in a plan or on the driver: fences are a table of a row a partition, joined as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PART, PLACE, NUMBER = "_part", "_place", "_idx"


@dataclass
class OrderIndex:
    rows: DataFrame    # the rows, with PART and PLACE
    fences: DataFrame  # PART, first (number of its first row), n
    total: int

    def numbered(self) -> DataFrame:
        """All rows with their number."""
        return self._with(self.fences)

    def seek(self, start: int, n: int) -> DataFrame:
        """Rows [start, start + n) with their number; only the folders that hold them are read."""
        met = self.fences.filter((F.col("first") < start + n) & (F.col("first") + F.col("n") > start))
        return self._with(met).filter(F.col(NUMBER).between(start, start + n - 1))

    def _with(self, fences: DataFrame) -> DataFrame:
        # a row a partition: some megabytes for 100,000 of them
        rows = self.rows.join(F.broadcast(fences.select(PART, "first")), PART)
        return rows.withColumn(NUMBER, F.col("first") + F.col(PLACE)).drop(PART, PLACE, "first")


def build(df: DataFrame, order: list[Column], partitions: int) -> OrderIndex:
    ordered = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # the id's lower 33 bits count the rows of a partition
    ordered = ordered.withColumns({PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialize(ordered, "ordered", partition_by=PART)
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))  # over a row a partition
    fences = materialize(counts.withColumn("first", F.coalesce(before, F.lit(0))), "fences")
    total = fences.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return OrderIndex(rows, fences, total)
