"""Distributed running sums."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import unsent
from tessera.functions.numeric import div_floor
from tessera.functions.store import stored

STRIDE = 1 << 16


def running_start(df: DataFrame, key: str, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of `value` over all rows with a smaller `key` (unique, non-negative), within each group of `by`.

    Two levels: sums of key ranges of STRIDE keys, a running sum over that small
    table, then a window inside each range. No task sees more than STRIDE keys,
    so no global sort of the whole table, or of one large group, meets in one task.
    """
    by = list(by)
    tagged = df.withColumn("_range", div_floor(F.col(key), STRIDE))
    sums = tagged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # Without groups there is a row of sums to a range, which may be broadcast.
    return (
        tagged.join(unsent(base) if by else base, [*by, "_range"])
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_range", "_base")
    )


def running_sum_in_order(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same group that come before in `order`, which has to tell all rows apart.

    Rows are sorted in ranges of (by, order) and written; a group that spans
    many ranges adds the sums of its earlier ranges, so no task sees more than one
    range, however large a group is.
    """
    by = list(by)
    at = stored(df.orderBy(*by, *order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    base = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return at.join(unsent(base) if by else base, [*by, "_part"]).withColumn(out, total.cast("long")).drop("_part", "_row", "_base")
