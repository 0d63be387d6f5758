"""Places of rows in an order, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialize


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in its ``group`` (none: among all rows) by ``order``.

    Rows are dealt by ranges of group and order, and numbered in each range. A group that goes on from one range
    to the next is the first of the latter, so what the ranges before it count is one row a range at most, which
    is broadcast. Rows that are equal in group and order come in any order, in one range.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    counts = dealt.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = materialize(counts.withColumn("_before", before).where("_before is not null").select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), "_before"), "ranges_before")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_{i}"))
    numbered = dealt.withColumn(name, inside.cast("long")).join(F.broadcast(carried), same, "left")
    return numbered.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
