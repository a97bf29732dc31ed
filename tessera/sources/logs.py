"""Readers of performance and timing logs."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The fields of a '|' log line, in order.
PERF_FIELDS = ["category", "sample", "m", "k", "n", "nnz", "window_num", "block_num", "fill_rate", "perf_us"]
PERF_TYPES = ["string", "string", "long", "long", "long", "long", "long", "long", "double", "double"]
REORDER_LINE = (
    r"^\[(.*?)\] \| Category: (.*?) \| Sample: (.*?) \| Dims\((\d+)\D+(\d+)\D+(\d+)\D+(\d+).*?\) \| Perf: ([0-9.]+).*?\| Verify: (.*)$"
)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): seq orders lines within a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("seq"),
        F.trim("value").alias("line"),
    )


def _fields(lines: DataFrame) -> DataFrame:
    parts = lines.withColumn("f", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)))
    typed = [
        (F.try_element_at("f", F.lit(i + 1)) if t == "string" else F.try_element_at("f", F.lit(i + 1)).try_cast(t)).alias(c)
        for i, (c, t) in enumerate(zip(PERF_FIELDS, PERF_TYPES, strict=True))
    ]
    return parts.select("*", *typed)


def perf_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the permissive reading; headings and rulers are skipped, short or unreadable rows rejected."""
    body = lines.filter((F.col("line") != "") & ~F.col("line").startswith("===") & ~F.col("line").startswith("Format"))
    read = _fields(body)
    good = (F.size("f") >= 10) & F.col("perf_us").isNotNull()
    return read.filter(good).select("file", "seq", *PERF_FIELDS), read.filter(~good).select("file", "seq", "line")


def perf_log_strict(lines: DataFrame) -> DataFrame:
    """The last row of each (category, sample); lines that begin with [, = or Format are skipped."""
    body = lines.filter((F.col("line") != "") & ~F.col("line").rlike(r"^(\[|=|Format)"))
    rows = _fields(body).filter((F.size("f") >= 10) & F.col("perf_us").isNotNull())
    rest = [c for c in PERF_FIELDS if c not in ("category", "sample")]
    last = F.max_by(F.struct(*rest), F.struct("file", "seq")).alias("r")
    return rows.groupBy("category", "sample").agg(last).select("category", "sample", "r.*")


def reorder_log(lines: DataFrame) -> DataFrame:
    """Rows of the bracketed log form: ts, category, sample, m, k, n, nnz, perf, verify."""
    hit = lines.filter(F.col("line").rlike(REORDER_LINE))
    part = lambda i: F.regexp_extract("line", REORDER_LINE, i)
    return hit.select(
        F.try_to_timestamp(part(1)).alias("ts"),
        part(2).alias("category"),
        part(3).alias("sample"),
        *[part(4 + i).cast("long").alias(c) for i, c in enumerate(("m", "k", "n", "nnz"))],
        part(8).cast("double").alias("perf"),
        part(9).alias("verify"),
    )


def timing_log(lines: DataFrame, timers: list[str] | None = None) -> DataFrame:
    """(file, sample, timer, run, ms): a line that names the timer, then 'Run n: x ms' on the next.

    `timers` keeps only those whose line holds one of these names; none takes
    all. Lines are numbered and grouped by split of a file, so a long log is no
    single task's; a run that opens a split takes the timer that closes the one
    before, and so does a sample's name. Only the run right after a timer counts.
    """
    run = r"^Run\s+(\d+):\s+([0-9.]+)\s*ms"
    full = lines.filter(F.col("line") != "").select("file", F.col("seq.at").alias("at"), "seq", "line")
    sample = F.when(F.col("line").startswith("Sample:"), F.trim(F.regexp_replace("line", "^Sample:", "")))
    inside = Window.partitionBy("file", "at").orderBy("seq")
    told = full.withColumns({"before": F.lag("line").over(inside), "name": F.last(sample, True).over(inside)})
    ends = told.groupBy("file", "at").agg(F.max_by("line", "seq").alias("last"), F.max_by(sample, F.when(sample.isNotNull(), F.col("seq"))).alias("named"))
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "at", F.lag("last").over(Window.partitionBy("file").orderBy("at")).alias("last"), F.last("named", True).over(earlier).alias("named"))
    runs = told.filter(F.col("line").rlike(run)).join(carried, ["file", "at"])
    timer = F.coalesce("before", "last")
    out = runs.select(
        "file",
        F.coalesce("name", "named").alias("sample"),
        F.regexp_replace(timer, r":\s*$", "").alias("timer"),
        F.regexp_extract("line", run, 1).cast("int").alias("run"),
        F.regexp_extract("line", run, 2).cast("double").alias("ms"),
    ).filter(F.col("timer").isNotNull() & ~F.col("timer").rlike(run))
    if timers is None:
        return out
    return out.filter(reduce(or_, [F.col("timer").contains(t) for t in timers], F.lit(False)))


def profiler_csv(spark: SparkSession, path: str, column: int = 2) -> DataFrame:
    """(perf_us): the third field of each data line with all but digits and points stripped; null if that is no number."""
    table = spark.read.csv(path, header=True)
    name = table.columns[column]
    return table.select(F.regexp_replace(F.col(f"`{name}`"), r"[^0-9.]", "").try_cast("double").alias("perf_us"))


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A '|' file without header, fields trimmed."""
    schema = ", ".join(f"{c} {t}" for c, t in zip(PERF_FIELDS, PERF_TYPES, strict=True))
    return spark.read.csv(path, sep="|", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
