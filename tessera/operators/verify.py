"""Tolerance checks of an output against a golden result."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import round_exact

# The tolerances of the check.
ATOL, RTOL, BAD_RATIO = 1e-6, 1e-4, 1e-4


def close(o: Column, g: Column) -> Column:
    """|o - g| <= atol + rtol |g|; NaN equals NaN; infinities must be equal."""
    return F.when(F.isnan(o) | F.isnan(g), F.isnan(o) & F.isnan(g)).otherwise(
        (o == g) | ((F.abs(g) < float("inf")) & (F.abs(o - g) <= ATOL + RTOL * F.abs(g)))
    )


def paired(output: DataFrame, golden: DataFrame) -> DataFrame:
    """(row, n, o, g) over the cells of either side; a missing cell is 0."""
    o = output.select("row", "n", F.col("val").alias("o"))
    g = golden.select("row", "n", F.col("val").alias("g"))
    return o.join(g, ["row", "n"], "full_outer").select(
        "row", "n", F.coalesce("o", F.lit(0.0)).alias("o"), F.coalesce("g", F.lit(0.0)).alias("g")
    )


def verify(output: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: cells, mismatches, ratio, passed."""
    counted = paired(output, golden).agg(
        F.count("*").alias("cells"), F.count_if(~close(F.col("o"), F.col("g"))).alias("mismatches")
    )
    ratio = F.when(F.col("cells") > 0, F.col("mismatches") / F.col("cells")).otherwise(0.0)
    return counted.select("cells", "mismatches", ratio.alias("ratio"), (ratio <= BAD_RATIO).alias("passed"))


def mismatches(output: DataFrame, golden: DataFrame) -> DataFrame:
    """The listed mismatches: golden zeros are left out; rdiff is the size of the error over the signed golden value."""
    bad = paired(output, golden).filter(~close(F.col("o"), F.col("g")) & (F.col("g") != 0))
    return bad.withColumn("rdiff", F.abs(F.col("o") - F.col("g")) / F.col("g"))


def dump_grid(c: DataFrame, n: int) -> DataFrame:
    """A bounded slice of columns as text, a line to a row."""
    wide = c.filter(F.col("n") < n).groupBy("row").pivot("n", list(range(n))).agg(F.first("val"))
    cells = [F.format_string("%6.1f", round_exact(F.coalesce(F.col(str(i)), F.lit(0.0)), 1)) for i in range(n)]
    return wide.select("row", F.concat_ws("\t", *cells).alias("line"))
