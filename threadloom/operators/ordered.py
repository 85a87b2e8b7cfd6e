"""Row numbers and running totals within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import checkpointed

ONE_TASK = 2_000_000  # rows of a group that a window takes in one task


def numbered(rows: DataFrame, group: list[str], order: list[Column], one_task: int = ONE_TASK, **totals: Column) -> DataFrame:
    """Adds rn (from 1 within the group, by ``order``), n (rows of the group) and running ``totals`` of whole numbers.

    ``rows`` should hold keys, not texts.  Where a group has more rows than ``one_task``, the rows are dealt by ranges
    of their order, each range is numbered by itself, and what lies before a range is added; the result is the same.
    """
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= one_task:
        whole = Window.partitionBy(*group)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", F.row_number().over(whole.orderBy(*order)).cast("bigint").alias("rn"), F.count("*").over(whole).alias("n"), *(F.sum(c).over(upto).alias(k) for k, c in totals.items()))
    names = [*totals]
    own = rows.select("*", *(c.cast("bigint").alias(k) for k, c in totals.items()))
    dealt = checkpointed(own.repartitionByRange(*group, *order)).withColumn("range", F.spark_partition_id())
    upto = Window.partitionBy("range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({"rn": F.row_number().over(upto).cast("bigint"), **{k: F.sum(k).over(upto) for k in names}})
    # a range shares a group only with its neighbours, so no more than two rows for each range are broadcast
    sums = dealt.groupBy("range", *group).agg(F.count("*").alias("rows"), *(F.sum(k).alias(f"sum_{k}") for k in names))
    ranges = Window.partitionBy(*group)
    before = ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ranges", F.count("*").over(ranges)).withColumns({"rows": F.sum("rows").over(before), **{f"sum_{k}": F.sum(f"sum_{k}").over(before) for k in names}}).where("ranges > 1").drop("ranges")
    out = local.join(F.broadcast(sums), ["range", *group], "left").join(counts, group)
    plus = {"rn": F.col("rn") + F.coalesce("rows", F.lit(0)), **{k: F.col(k) + F.coalesce(f"sum_{k}", F.lit(0)) for k in names}}
    return reduce(lambda df, k: df.withColumn(k, plus[k]), plus, out).select(*rows.columns, "rn", "n", *names)
