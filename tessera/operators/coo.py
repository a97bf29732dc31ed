"""Coordinate matrices: DataFrame(row long, col long, val double), the canonical form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.joins import unsent
from tessera.functions.numeric import round_f16


def matrix_meta(coo: DataFrame, m: int | None = None, k: int | None = None) -> DataFrame:
    """One row: m, k, nnz. Dimensions default to the largest index plus one."""
    return coo.agg(
        (F.lit(m) if m is not None else F.coalesce(F.max("row") + 1, F.lit(0))).cast("long").alias("m"),
        (F.lit(k) if k is not None else F.coalesce(F.max("col") + 1, F.lit(0))).cast("long").alias("k"),
        F.count("*").alias("nnz"),
    )


def dedup(coo: DataFrame, duplicates: str = "sum", order_by: list[str] | None = None) -> DataFrame:
    """Merges repeated coordinates: their sum, or the last by an explicit total order."""
    if duplicates == "sum":
        agg = F.sum("val")
    elif duplicates == "last":
        if not order_by:
            raise ValueError("duplicates='last' needs order_by")
        agg = F.max_by("val", F.struct(*order_by))
    else:
        raise ValueError(f"unknown duplicate policy {duplicates!r}")
    return coo.groupBy("row", "col").agg(agg.alias("val"))


def within_bounds(coo: DataFrame, m: int, k: int) -> DataFrame:
    """Keeps entries inside an m x k matrix."""
    return coo.filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < m) & (F.col("col") < k))


def count_out_of_bounds(coo: DataFrame, m: int, k: int) -> DataFrame:
    bad = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("row") >= m) | (F.col("col") >= k)
    return coo.agg(F.count_if(bad).alias("dropped"), F.count("*").alias("total"))


def expand_symmetry(coo: DataFrame, sign: float | Column = 1.0) -> DataFrame:
    """Adds the mirrored entry of each off-diagonal one (sign -1 for skew). Keeps all columns."""
    mirror = coo.filter("row <> col").withColumns({"row": F.col("col"), "col": F.col("row"), "val": F.col("val") * sign})
    return coo.unionByName(mirror)


def to_f16(coo: DataFrame) -> DataFrame:
    return coo.withColumn("val", round_f16(F.col("val")))


def permute_rows(coo: DataFrame, order: DataFrame) -> DataFrame:
    """Rows renumbered by order(new_row, old_row)."""
    return coo.join(unsent(order), F.col("row") == F.col("old_row")).select(
        F.col("new_row").alias("row"), *[c for c in coo.columns if c != "row"]
    )


def restore_rows(c: DataFrame, order: DataFrame) -> DataFrame:
    """Undoes permute_rows on a result: a row at new_row goes back to old_row."""
    return c.join(unsent(order), F.col("row") == F.col("new_row")).select(
        F.col("old_row").alias("row"), *[x for x in c.columns if x != "row"]
    )


def pad_rows(order: DataFrame, m: int, m_pad: int) -> DataFrame:
    """Appends the identity for pad rows m..m_pad-1."""
    pads = order.sparkSession.range(m, m_pad).select(F.col("id").alias("new_row"), F.col("id").alias("old_row"))
    return order.select("new_row", "old_row").unionByName(pads)
