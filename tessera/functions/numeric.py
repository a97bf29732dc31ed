"""Column expressions shared by the matrix operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the half-precision format.
F16_MAX = 65504.0
F16_OVERFLOW = 65520.0
F16_MIN_ULP = 2.0**-24

BLOCK = 16


def round_f16(x: Column) -> Column:
    """x rounded to the nearest half-precision value (ties to even), as a double."""
    mag = F.abs(x)
    ulp = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(mag)) - 10), F.lit(F16_MIN_ULP))
    signed_inf = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when(x.isNull() | F.isnan(x) | (x == 0), x.cast("double"))
        .when(mag >= F16_OVERFLOW, signed_inf)
        .otherwise(F.rint(x / ulp) * ulp)
    )


def div_floor(x: Column, n: int) -> Column:
    """Integer quotient of an id, rounded down; exact for all ids, as no doubles are used."""
    x = x.cast("long")
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def ceil_div(x: Column, n: int) -> Column:
    return -div_floor(-x.cast("long"), n)


def round_up(x: Column, n: int = BLOCK) -> Column:
    return ceil_div(x, n) * n


def round_exact(x: Column, places: int) -> Column:
    """x rounded to so many places by the exact value of the double, ties to even, as printf does.

    x is split in two halves whose products with 2 * 10^places are exact, so the
    comparison with the middle between two candidates is exact too.
    """
    scale = 10.0**places
    mag = F.abs(x)
    wide = mag * 134217729.0
    high = wide - (wide - mag)
    below = F.floor(mag * scale)
    over = (high * (2 * scale) - (below * 2 + 1)) + (mag - high) * (2 * scale)
    up = (over > 0) | ((over == 0) & (below % 2 == 1))
    return F.signum(x) * (below + up.cast("int")) / scale


def dense_b_value(k: Column, n: Column) -> Column:
    """The deterministic integer entries 1..10 of the synthetic dense operand."""
    return (F.lit(1) + (k * 31 + n * 17) % 10).cast("double")


def fill_fraction(nnz: Column, blocks: Column, cells: int = BLOCK * BLOCK) -> Column:
    """Share of a stored block that holds entries, to two places."""
    return F.when(blocks > 0, F.round(nnz / (blocks * cells), 2)).otherwise(0.0)


def fill_mean(nnz: Column, blocks: Column, cells: int = BLOCK * BLOCK) -> Column:
    """Mean entries per block, from the rounded fraction."""
    return fill_fraction(nnz, blocks, cells) * cells


def fill_per_block(nnz: Column, blocks: Column) -> Column:
    """Entries over blocks, to two places."""
    return F.when(blocks > 0, F.round(nnz / blocks, 2)).otherwise(0.0)
