"""A matrix kept current from a stream of entries, and the rows of a product that its changes touch.

Operators that are one aggregate, such as the product with the synthetic operand,
run over a stream as they are. Where a later entry replaces an earlier one at the
same place, a sum over the stream would be wrong: the newest entries of each batch
are logged here, and the newest of the log count. The stream itself keeps no state.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "row long, col long, newest struct<seq: long, val: double>, batch long"


def as_glob(path: str) -> str:
    """The path as a pattern for itself: a stream takes a plain path for a folder, and a table may be one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def newest(entries: DataFrame) -> DataFrame:
    """(row, col, newest): of the entries (row, col, val, seq) at a place that of highest seq, of equal ones the greatest value.

    Partial maxima run before the shuffle, so a place that is written very often
    is no task's burden. Entries without row, column or seq are left out; a null
    value counts as least.
    """
    placed = entries.dropna(subset=["row", "col", "seq"])
    return placed.groupBy("row", "col").agg(F.max(F.struct(F.col("seq").cast("long").alias("seq"), F.col("val").cast("double").alias("val"))).alias("newest"))


def follow(entries: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what the stream holds beyond its checkpoint and logs the places it touched at `path`, a folder for each batch.

    A batch that is done twice replaces its own folder, so a run may be broken off and begun again.
    A place is logged with the newest of the batch's entries, even if the log has a newer one.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    # The log is there, if empty, before the first batch.
    entries.sparkSession.createDataFrame([], LOG).write.mode("append").partitionBy("batch").parquet(path)
    entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val): the matrix as it stands after all logged batches."""
    return _standing(spark.read.schema(LOG).parquet(path))


def refreshed(spark: SparkSession, path: str, since: int, multiply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """multiply(A) for those rows of A alone that batches after `since` touched: what replaces these rows of C."""
    log = spark.read.schema(LOG).parquet(path)
    touched = log.filter(F.col("batch") > since).select("row").distinct()
    return multiply(_standing(log.join(touched, "row", "left_semi")))


def _standing(log: DataFrame) -> DataFrame:
    return log.groupBy("row", "col").agg(F.max("newest").alias("newest")).select("row", "col", F.col("newest.val").alias("val"))
