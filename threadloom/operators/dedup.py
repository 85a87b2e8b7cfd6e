"""One row for each key: the newest content at the place of the first copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_latest(rows: DataFrame, key: list[str], fresh: str, order: list[str]) -> DataFrame:
    """Of each key the row with the largest ``fresh`` (null is least; ``order`` decides ties), with ``pos``: the first
    place of the key in ``order``, which tells all rows apart and holds no nulls.

    Winners are picked among keys and places, with partial results before the shuffle; whole rows only meet them.
    """
    age = -F.coalesce(F.col(fresh).cast("double"), F.lit(float("-inf")))
    best = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("pos"), F.min(F.struct(age.alias("age"), *order)).alias("best"))
    winners = best.select("pos", *(F.col(f"best.{c}").alias(c) for c in order))
    return rows.join(winners, order)
