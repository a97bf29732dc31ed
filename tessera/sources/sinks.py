"""Writers for matrices, layouts and reports."""

import json
from collections.abc import Sequence
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.logs import PERF_FIELDS


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Columnar form of any relation (arrays, blocks, B, golden, C, core split)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite", header: bool = False, sep: str = ",") -> None:
    """Text form; arrays become space-separated numbers and strings are trimmed."""
    flat = [
        F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))).alias(c) if t.startswith("array") else (F.trim(c).alias(c) if t == "string" else F.col(c))
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode(mode).csv(path, header=header, sep=sep)


def write_metadata(df: DataFrame, path: str) -> None:
    """A table of one row as KEY=value lines."""
    pairs = F.array(*[F.concat(F.lit(c.upper() + "="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    df.limit(1).select(F.explode(pairs).alias("value")).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=value lines."""
    return spark.read.text(path).select(F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, instr(value, '=') + 1)").alias("value")).filter("key <> ''")


def write_lines(df: DataFrame, path: str) -> None:
    """df(place, line) as text in order of place: the parts' names keep the order."""
    df.orderBy("place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of a performance log, fields parted by ' | '; a null is an empty field."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PERF_FIELDS]
    df.select(F.concat_ws(" | ", *fields).alias("value")).write.mode("append").text(path)


def append_reorder_log(df: DataFrame, path: str) -> None:
    """Rows ts, category, sample, m, k, n, nnz, perf, verify in the bracketed form."""
    line = F.format_string("[%s] | Category: %s | Sample: %s | Dims(%d, %d, %d, %d) | Perf: %s | Verify: %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "category", "sample", "m", "k", "n", "nnz", F.col("perf").cast("string"), "verify")
    df.select(line.alias("value")).write.mode("append").text(path)


def append_timings(df: DataFrame, path: str) -> None:
    """timings(sample, timer, run, ms) as a stanza for each sample: its name, then each timer with its runs and a rule."""
    runs = df.groupBy("sample", "timer").agg(F.array_sort(F.collect_list(F.struct("run", "ms"))).alias("r"))
    line = lambda x: F.format_string("    Run %d: %.6f ms", x["run"], x["ms"])
    text = F.concat(F.lit("  "), "timer", F.lit(":\n"), F.array_join(F.transform("r", line), "\n"))
    stanza = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timer", text.alias("t")))), lambda x: x["t"]), "\n")
    body = runs.groupBy("sample").agg(stanza.alias("s"))
    body.select(F.concat(F.lit("Sample: "), "sample", F.lit("\n"), "s", F.lit("\n" + "-" * 40)).alias("value")).write.mode("append").text(path)


def fingerprint(spark: SparkSession, inputs: Sequence[str] = (), params: dict | None = None) -> str:
    """A digest of what a table is built from: the names, sizes and times of all input files, and the parameters.

    Files are listed and digested by Spark, without their contents, so inputs may
    be many and remote. A table that changes in any file gets another digest.
    """
    told = json.dumps(params or {}, sort_keys=True, default=str)
    if not inputs:
        return sha256(told.encode()).hexdigest()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs)).select("path", "length", F.unix_micros("modificationTime").alias("t"))
    # Sums of hashes don't depend on the order of the files.
    each = F.sha2(F.concat_ws("|", "path", "length", "t"), 256)
    part = lambda i: F.sum(F.conv(F.substring(each, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
    sums = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), *[part(i) for i in range(8)]).first()
    return sha256((told + "|" + "|".join(map(str, sums))).encode()).hexdigest()


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether the mark beside a table is there; it is written after the table."""
    try:
        return not spark.read.schema("done string").text(f"{path}.done").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def reuse_or_build(spark: SparkSession, path: str, build, inputs: Sequence[str] = (), params: dict | None = None) -> DataFrame:
    """The table below path that was built from these inputs and parameters, else build() written there.

    Each fingerprint has a folder of its own, so a changed input gives a new table
    and readers of the old one keep theirs. A table that was not finished has no mark
    beside it and is written again.
    """
    place = f"{path}/{fingerprint(spark, inputs, params)}"
    if not _finished(spark, place):
        write_table(build(), place)
        spark.createDataFrame([("done",)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}.done")
    return spark.read.parquet(place)


def report_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width text lines of a report."""
    return df.select(F.concat_ws(" ", *[F.rpad(F.col(c).cast("string"), w, " ") for c, w in widths.items()]).alias("line"))
