"""Even split of consecutive blocks over workers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import div_floor
from tessera.functions.prefix import running_start


def core_split(window_blocks: DataFrame, cores: int = 24) -> DataFrame:
    """window_blocks(rw, nblocks), all windows, empty ones too -> (core, rw_start, rw_end, blk_start, blk_end).

    Core c gets b + (c < r) consecutive blocks, where b, r = divmod(total, cores),
    so the largest load is ceil(total / cores). A core that starts on a window's
    first block starts where its predecessor stopped, so empty windows belong
    to the core that follows. Idle cores get [n, n, 0, 0].
    """
    spark = window_blocks.sparkSession
    starts = running_start(window_blocks.select("rw", "nblocks"), "rw", "nblocks", "start")
    total = window_blocks.agg(
        F.coalesce(F.sum("nblocks"), F.lit(0)).alias("total"), F.coalesce(F.max("rw") + 1, F.lit(0)).alias("n")
    )
    c = F.col("core")
    base, extra = div_floor(F.col("total"), cores), F.col("total") % cores
    bounds = spark.range(cores).withColumnRenamed("id", "core").join(total).select(
        c.cast("int").alias("core"),
        "n",
        (c * base + F.least(c, extra)).alias("g0"),
        ((c + 1) * base + F.least(c + 1, extra)).alias("g1"),
    )
    # One row for each core, so it may be broadcast.
    busy = F.broadcast(bounds.filter("g1 > g0"))
    at = starts.filter("nblocks > 0")
    first = at.join(busy, (F.col("g0") >= F.col("start")) & (F.col("g0") < F.col("start") + F.col("nblocks"))).select(
        "core", F.col("rw").alias("rw_first"), (F.col("g0") - F.col("start")).alias("blk_start")
    )
    last = at.join(busy, (F.col("g1") > F.col("start")) & (F.col("g1") <= F.col("start") + F.col("nblocks"))).select(
        "core", (F.col("rw") + 1).alias("rw_end"), (F.col("g1") - F.col("start")).alias("blk_end")
    )
    previous_end = F.coalesce(F.lag("rw_end").over(Window.orderBy("core")), F.lit(0))
    placed = first.join(last, "core").withColumn(
        "rw_start", F.when(F.col("blk_start") > 0, F.col("rw_first")).otherwise(previous_end)
    )
    return bounds.join(placed, "core", "left").select(
        "core",
        F.coalesce("rw_start", "n").cast("long").alias("rw_start"),
        F.coalesce("rw_end", "n").cast("long").alias("rw_end"),
        F.coalesce("blk_start", F.lit(0)).cast("long").alias("blk_start"),
        F.coalesce("blk_end", F.lit(0)).cast("long").alias("blk_end"),
    )
