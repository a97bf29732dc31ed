"""Joins that bear hot keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
SALTS = 8


def unsent(rows: DataFrame) -> DataFrame:
    """rows, for a join by a sort on both sides: none is gathered by the driver and broadcast, however few bytes its files have.

    Files of consecutive numbers take a byte or two a row and a hundred times that
    in the driver, so Spark's own choice by size fills its memory.
    """
    return rows.hint("merge")


def spread_join(rows: DataFrame, looked_up: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with looked_up, which has each key once, on `key`; the rows of a key are dealt to several tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    copies = looked_up.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(unsent(copies), [key, "_salt"], how).drop("_salt")
