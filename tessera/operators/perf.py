"""Analytics over performance records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import round_exact
from tessera.functions.prefix import running_sum_in_order
from tessera.functions.store import dropped, stored

# Speedups beyond these count as a change.
IMPROVED, REGRESSED = 1.005, 0.995
# Columns of a log that a comparison carries along.
CARRIED = ("m", "block_num")

#: Ranges that a pass for a median counts.
BUCKETS = 4096


def by_group(df: DataFrame, group: str = "category", value: str = "perf_us") -> DataFrame:
    """(group, total, samples, mean, pct) per group; pct is 0 when the grand total is 0."""
    per = df.groupBy(group).agg(F.sum(value).alias("total"), F.count(value).alias("samples"), F.avg(value).alias("mean"))
    whole = F.col("_whole")
    summed = per.crossJoin(F.broadcast(df.agg(F.sum(value).alias("_whole"))))
    return summed.withColumn("pct", F.when(whole == 0, 0.0).otherwise(100 * F.col("total") / whole)).drop("_whole")


def with_grand_total(df: DataFrame, group: str = "category", value: str = "perf_us") -> DataFrame:
    """by_group's sums with one more row whose group is null."""
    return df.rollup(group).agg(F.sum(value).alias("total"), F.count(value).alias("samples"), F.avg(value).alias("mean"))


def compare(base: DataFrame, opt: DataFrame, keys=("category", "sample"), value: str = "perf_us") -> DataFrame:
    """(keys, base, opt, diff, speedup, verdict) for the samples on both sides, with the base's other columns m and block_num if it has them.

    An optimised time of 0 or less counts as an infinite speedup.
    """
    keys = list(keys)
    carried = [c for c in CARRIED if c in base.columns and c not in keys]
    b, o = base.select(*keys, F.col(value).alias("base"), *carried), opt.select(*keys, F.col(value).alias("opt"))
    speedup = F.when(F.col("opt") > 0, F.try_divide(F.col("base"), F.col("opt"))).when(F.col("opt") <= 0, F.lit(float("inf")))
    verdict = F.when(speedup > IMPROVED, "improved").when(speedup < REGRESSED, "regressed").otherwise("unchanged")
    return b.join(o, keys).select(
        *keys, "base", "opt", (F.col("base") - F.col("opt")).alias("diff"), speedup.alias("speedup"), verdict.alias("verdict"), *carried
    )


SORTS = {
    "speedup": "speedup",
    "abs": "diff",
    "sample": ("category", "sample"),
    "blocks": "block_num",
}


def sort_report(report: DataFrame, by: str = "speedup") -> DataFrame:
    """Ordered by speedup, absolute gain or block count (largest first), or by category and sample; ties by the latter."""
    if by not in SORTS:
        raise ValueError(f"unknown sort key {by!r}")
    names = SORTS["sample"]
    return report.orderBy(*names) if by == "sample" else report.orderBy(F.desc(SORTS[by]), *names)


def placed_report(report: DataFrame, by: str = "speedup") -> DataFrame:
    """report + place, gapless from 1 in the order of `sort_report`, without gathering the rows in a task."""
    if by not in SORTS:
        raise ValueError(f"unknown sort key {by!r}")
    names = [F.col(c) for c in SORTS["sample"]]
    order = names if by == "sample" else [F.desc(SORTS[by]), *names]
    placed = running_sum_in_order(report.withColumn("_one", F.lit(1)), [], order, "_one", "_before")
    return placed.withColumn("place", F.col("_before") + 1).drop("_one", "_before")


def middle(df: DataFrame, value: str) -> float | None:
    """The exact median of a column, the mean of the two middle values of an even number; null for no values.

    Each pass counts the values in BUCKETS ranges between the bounds so far and
    goes on in the range that holds the middle, until it is a single value. A pass
    gathers a row for each range, and no task sees more than its share of the rows.
    """
    values = stored(df.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull()))
    n = values.count()
    if not n:
        return None

    def at(rank: int) -> float:
        """The value with so many before it. Infinite values and NaN, the greatest, are ranges of their own."""
        lo = hi = None
        while True:
            inside = values if lo is None else values.filter((F.col("x") >= lo) & (F.col("x") <= hi))
            ends = inside.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.when(F.abs("x") < float("inf"), F.col("x"))).alias("a"), F.max(F.when(F.abs("x") < float("inf"), F.col("x"))).alias("b")).first()
            if ends["lo"] == ends["hi"] or ends["a"] is None and ends["lo"] != ends["lo"]:
                return ends["lo"]
            a, b = ends["a"] or 0.0, ends["b"] or 0.0
            # Halves, as the width of all doubles is none.
            share = (F.col("x") / 2 - a / 2) / (b / 2 - a / 2) if b > a else F.lit(0.0)
            bucket = F.when(F.isnan("x"), BUCKETS + 2).when(F.col("x") == float("inf"), BUCKETS + 1).when(F.col("x") == float("-inf"), -1).otherwise(F.floor(share * BUCKETS))
            rows = inside.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bucket").collect()
            for r in rows:
                if rank < r["n"]:
                    break
                rank -= r["n"]
            lo, hi = r["lo"], r["hi"]
            if lo == hi or lo != lo:
                return lo

    low, high = at((n - 1) // 2), at(n // 2)
    dropped(values)
    return low if low == high else low + (high - low) / 2


def valid(df: DataFrame, zeros: bool = False, value: str = "perf_us") -> DataFrame:
    """Rows with a usable time: numbers, without signs. A time of 0 is a failed profile; `zeros` keeps it, as the reorder mode does, and so lowers means."""
    fine = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) < float("inf"))
    return df.filter(fine & (F.col(value) >= 0 if zeros else F.col(value) > 0))


def ordered(df: DataFrame) -> DataFrame:
    """Samples in the order of the detailed report, by category, then by name, equal names by time; + place in the category, from 1."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("sample", "perf_us"))
    return df.withColumn("place", place).orderBy("category", "place")


def _to(places: int, *names: str) -> list[Column]:
    """Columns rounded for a report, as the formatter would round their shortest decimal form; infinite values are kept."""
    return [F.when(F.abs(n) < float("inf"), round_exact(F.col(n), places)).otherwise(F.col(n)) for n in names]


def category_report(df: DataFrame) -> DataFrame:
    """(line) of the category summary: headings, a line for each category in order, and the total."""
    names = [("category", -15), ("samples", 10), ("total_us", 15), ("mean_us", 15), ("pct", 10)]
    row = "%-15s %-10d %-15.2f %-15.2f %-10.2f"
    head = " ".join(f"{n:<{abs(w)}}" for n, w in names)
    body = by_group(df).select(F.lit(1).alias("part"), F.col("category").alias("at"), F.format_string(row, "category", "samples", *_to(2, "total", "mean", "pct")).alias("line"))
    whole = df.agg(F.count("perf_us").alias("n"), F.coalesce(F.sum("perf_us"), F.lit(0.0)).alias("t"), F.coalesce(F.avg("perf_us"), F.lit(0.0)).alias("m"))
    total = whole.select(F.lit(3).alias("part"), F.lit("").alias("at"), F.format_string(row, F.lit("total"), "n", *_to(2, "t", "m"), F.lit(100.0)).alias("line"))
    rules = df.sparkSession.createDataFrame([(0, "a", "-" * 80), (0, "b", head), (0, "c", "-" * 80), (2, "", "-" * 80)], "part int, at string, line string")
    return rules.unionByName(body).unionByName(total).orderBy("part", "at")


def compare_report(report: DataFrame, base: DataFrame, opt: DataFrame, by: str = "speedup") -> DataFrame:
    """(part, place, line) of the comparison: headings, a line for each sample in order, counts, totals and one-sided samples.

    place orders the lines of a part; it is unique but not gapless, as samples are ordered without being gathered.
    """
    spark, rule = report.sparkSession, "-" * 100
    # The heading and the line format of the comparison report.
    head = f"{'Category':<20} {'Sample':<25} {'M':>6} {'Blocks':>7} {'Base(us)':>10} {'Opt(us)':>10} {'Diff(us)':>10} {'Speedup':>8}"
    line = F.format_string(
        "%-20s %-25s %6d %7d %10.2f %10.2f %10.2f %7.3fx", "category", "sample", F.coalesce("m", F.lit(0).cast("long")), F.coalesce("block_num", F.lit(0).cast("long")), *_to(2, "base", "opt", "diff"), *_to(3, "speedup")
    )
    body = sort_report(report, by).select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("place"), line.alias("line"))
    s = summary(report)
    sums = report.agg(F.coalesce(F.sum("base"), F.lit(0.0)).alias("tb"), F.coalesce(F.sum("opt"), F.lit(0.0)).alias("to"))
    sides = only_one_side(base, opt).agg(F.count_if(F.col("side") == "base").alias("ob"), F.count_if(F.col("side") == "opt").alias("oo"))
    lines = [
        F.format_string("samples: %d", "samples"),
        F.format_string("improved: %d, unchanged: %d, regressed: %d", "improved", "unchanged", "regressed"),
        F.format_string("total: baseline=%.2fus, optimized=%.2fus, ratio=%.3fx", *_to(2, "tb", "to"), *_to(3, "total_ratio")),
        F.format_string("speedup: min=%.3fx, max=%.3fx, mean=%.3fx, median=%.3fx", *_to(3, "min_speedup", "max_speedup", "mean_speedup", "median_speedup")),
        F.format_string("only in baseline: %d", "ob"),
        F.format_string("only in optimized: %d", "oo"),
    ]
    tail = s.join(sums).join(sides).select(F.lit(2).alias("part"), F.posexplode(F.array(F.lit(rule), *lines)).alias("place", "line"))
    top = spark.createDataFrame([(0, 0, head), (0, 1, rule)], "part int, place long, line string")
    return top.unionByName(body).unionByName(tail.withColumn("place", F.col("place").cast("long"))).orderBy("part", "place")


def summary(report: DataFrame) -> DataFrame:
    """One row over a comparison: class counts, min, max, mean and median speedup, total ratio."""
    return report.agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("verdict") == "improved").alias("improved"),
        F.count_if(F.col("verdict") == "unchanged").alias("unchanged"),
        F.count_if(F.col("verdict") == "regressed").alias("regressed"),
        F.min("speedup").alias("min_speedup"),
        F.max("speedup").alias("max_speedup"),
        F.avg("speedup").alias("mean_speedup"),
        F.lit(middle(report, "speedup")).cast("double").alias("median_speedup"),
        F.try_divide(F.sum("base"), F.sum("opt")).alias("total_ratio"),
    )


def only_one_side(base: DataFrame, opt: DataFrame, keys=("category", "sample")) -> DataFrame:
    """(keys, side) of the samples that only one side has."""
    keys = list(keys)
    left = base.join(opt, keys, "left_anti").select(*keys, F.lit("base").alias("side"))
    return left.unionByName(opt.join(base, keys, "left_anti").select(*keys, F.lit("opt").alias("side")))


def mean_time(timings: DataFrame) -> DataFrame:
    """timings(sample, timer, run, ms) -> (timer, runs, total_ms, mean_ms)."""
    return timings.groupBy("timer").agg(
        F.count("*").alias("runs"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms")
    )
