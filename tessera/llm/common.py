"""Helpers shared by the corpus operators."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, and its complement.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; null for null."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def fresh(name: str, taken) -> str:
    """A column name like `name` that is none of those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of the caller's columns can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
