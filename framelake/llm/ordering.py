"""Places and running totals in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.runtime import Scratch

_INNER = 33  #: bits of ``monotonically_increasing_id`` that count the rows of a partition


def running(df: DataFrame, order: list[Column], scratch: Scratch, weight: str | None = None, name: str = "at") -> DataFrame:
    """``df`` with ``name``: how much ``weight`` (a long column; none: one a row) comes before each row in ``order``.

    Rows are sorted by ranges, so rows of equal order are beside each other in one range; let a unique
    column end the order where there may be very many. What meets in one task is a total for each
    range, not rows. Nulls of the order come first; a null weight counts nothing. The result reads
    steps of ``scratch``.
    """
    ends = [c.asc_nulls_first() for c in order]
    dealt = scratch.staged(df.repartitionByRange(*ends).sortWithinPartitions(*ends).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _INNER).alias("_part")
    amount = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("long")
    totals = dealt.groupBy(part).agg(F.sum(amount).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = scratch.staged(totals.select("_part", before.alias("_first")))  # as many rows as ranges
    if weight is None:
        inner = F.col("_place").bitwiseAND((1 << _INNER) - 1)
    else:
        inner = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + inner).drop("_part", "_place", "_first")
