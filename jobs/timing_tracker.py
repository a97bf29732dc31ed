"""Times of runs, taken as they arrive: daily sums for each category and sample, and a report of what got faster or slower.

The table of events is a stream of files. A run takes the files that its
checkpoint hasn't seen, sums them up by day and appends the sums to `daily`,
partitioned by batch and day: late events of a day come in a later batch of their
own, and a batch that is done twice replaces its own partitions. Times that are
null, not finite or not positive go to `rejected`, counted by reason. Then
`report`, partitioned by verdict, is made anew from the sums: each sample's mean time over the
first `base_days` days against its mean since. A run without new files leaves
`daily` as it is and makes the same report.

Times are kept in whole thousandths, so sums don't depend on their order. Days
are UTC days of zoneless timestamps. Files are told by their paths: one that is
written anew under its old name is not taken again.
"""

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, with_defaults
from tessera.operators import perf
from tessera.streaming.incremental import as_glob

log = logging.getLogger("jobs.timing_tracker")

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
TABLES = {
    "daily": "category string, sample string, total long, samples long, batch long, day date",
    "rejected": "reason string, events long, batch long",
    "report": "category string, sample string, base double, opt double, diff double, speedup double, verdict string",
}
#: The columns that partition a table; the writer of a batch replaces its own partitions.
KEYS = {"daily": ["batch", "day"], "rejected": ["batch"], "report": ["verdict"]}


def reason(value: Column) -> Column:
    """Why a time is of no use; null for a good one."""
    return F.when(value.isNull(), "null").when(F.isnan(value) | (F.abs(value) == float("inf")), "not finite").when(value < 0, "negative").when(value == 0, "zero")


def daily_sums(events: DataFrame, zeros: bool) -> DataFrame:
    good = perf.valid(events, zeros, "value")
    thousandths = F.round(F.col("value") * 1000).cast("long")
    return good.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("sample")).agg(
        F.sum(thousandths).alias("total"), F.count("*").alias("samples")
    )


def changes(daily: DataFrame, base_days: int) -> DataFrame:
    """The comparison of each sample's mean time in the first days with its mean since."""
    first = daily.agg(F.min("day").alias("first"))
    dated = daily.crossJoin(F.broadcast(first)).withColumn("early", F.datediff("day", "first") < base_days)
    side = lambda early: dated.filter(F.col("early") == early).groupBy("category", "sample").agg((F.sum("total") / F.sum("samples")).alias("perf_us"))
    return perf.compare(side(True), side(False))


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes the new files of the table at `events`; returns how many events were taken and rejected, and the report's rows."""
    conf = with_defaults("timing_tracker", config)
    told = {"taken": 0, "rejected": 0, "batches": 0}

    def take(batch: DataFrame, number: int) -> None:
        why = reason(F.col("value"))
        if conf["zeros"]:
            why = F.when(why != "zero", why)
        seen = batch.agg(F.count("*").alias("taken"), F.count(why).alias("rejected")).first()
        useless = batch.select(why.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("events"))
        _write(daily_sums(batch, conf["zeros"]).withColumn("batch", F.lit(number).cast("long")), output, "daily", "dynamic")
        _write(useless.withColumn("batch", F.lit(number).cast("long")), output, "rejected", "dynamic")
        log.info("batch %d: read %d events, rejected %d", number, seen["taken"], seen["rejected"])
        for name in ("taken", "rejected"):
            told[name] += seen[name]
        told["batches"] += 1

    # The tables are there, if empty, before the first batch.
    for name in ("daily", "rejected"):
        spark.createDataFrame([], TABLES[name]).write.mode("append").partitionBy(*KEYS[name]).parquet(f"{output}/{name}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", conf["files_per_batch"]).parquet(as_glob(events))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

    _write(changes(table(spark, output, "daily"), conf["base_days"]), output, "report", "static")
    told["report"] = table(spark, output, "report").count()
    log.info("read %(taken)d new events in %(batches)d batches, %(rejected)d of no use; wrote a report of %(report)d rows", told)
    return told


def _write(df: DataFrame, output: str, name: str, replaced: str) -> None:
    """Replaces the whole table, or (dynamic) the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", replaced).partitionBy(*KEYS[name]).parquet(f"{output}/{name}")


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table of the output as it stands: daily, rejected or report."""
    return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}")


if __name__ == "__main__":
    main("timing_tracker", run, __doc__.split("\n")[0], {"events": "the table of events: a folder, a file or a pattern", "output": "the folder to write", "checkpoint": "the stream's checkpoint"})
