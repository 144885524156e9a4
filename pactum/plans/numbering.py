"""Numbers in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.plans.stage import staged

_IN_PARTITION = 33  # bits of monotonically_increasing_id that count within a partition


def numbered(df: DataFrame, by: list[str], name: str = "number", path: str | None = None) -> DataFrame:
    """df with `name`: 0, 1, ... in the order of `by` over all rows; of equal rows in any order.

    Rows are dealt to ranges and sorted there; what one task adds up is a count for each range. The numbers are written, so every
    use sees the same ones.
    """
    at = "__at"
    rows = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), path)
    part = F.shiftright(at, _IN_PARTITION)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.col(at).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return rows.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__start") + inside).select(*df.columns, name)
