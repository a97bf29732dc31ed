"""Headerless binary arrays.

An array is a file or, written in parallel, a folder whose name ends in `.bin`
with parts in order of their names.
"""

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a file that a task reads at once; longer files are read in ranges of so many.
RANGE_BYTES = 64 << 20
#: Elements of a batch of rows.
BATCH = 1 << 16


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def read_array(spark: SparkSession, path: str, dtype: str = "int32", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, idx, value double): the elements of each array; empty files and broken elements are an error.

    Files are listed by Spark without their contents. Those of up to range_bytes are
    read whole by Spark; longer ones, of any length, are dealt out in ranges.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    # Spark gives no row for an empty file, so those listed are counted against those read.
    if len(files.inputFiles()) != files.count():
        raise ValueError(f"not an array of this type, as a file is empty: {path}")
    width = np.dtype(dtype).itemsize
    step = max(range_bytes // width, 1) * width
    # Places follow from the parts' lengths, which are read without their contents.
    whole = F.when(F.col("path").rlike(r"\.bin/[^/]*$"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.col("path"))
    before = Window.partitionBy("file").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select(whole.alias("file"), "path", "length").select("file", "path", "length", (F.coalesce(F.sum("length").over(before), F.lit(0)) / width).cast("long").alias("start"))
    bad = (F.col("length") == 0) | (F.col("length") % width != 0)
    fail = F.raise_error(F.concat(F.lit("not an array of this type: "), "path"))
    short = files.filter(F.col("length") <= step).select("path", F.when(bad, fail.cast("binary")).otherwise(F.col("content")).alias("content"))
    short = short.join(places.select("file", "path", "start"), "path").select("file", "start", "content")
    long = places.filter(F.col("length") > step).withColumn("length", F.when(bad, fail.cast("long")).otherwise(F.col("length")))
    ranges = long.select("file", "path", "start", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    ranges = ranges.select("file", "path", (F.col("start") + F.col("at") / width).cast("long").alias("start"), "at", F.least(F.col("length") - F.col("at"), F.lit(step)).cast("long").alias("size"))

    def rows(name, start, values):
        for i in range(0, len(values), BATCH):
            part = values[i : i + BATCH].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(start + i, start + i + len(part))), pa.array(part)], ["file", "idx", "value"])

    def decode(batches):
        for batch in batches:
            for name, start, content in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("content"), strict=True):
                yield from rows(name, start, np.frombuffer(content.as_buffer(), dtype=dtype))

    def fetch(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, place = _opened(r["path"])
                with fs.open_input_file(place) as f:
                    f.seek(r["at"])
                    yield from rows(r["file"], r["start"], np.frombuffer(f.read(r["size"]), dtype=dtype))

    schema = "file string, idx long, value double"
    # Ranges are dealt one by one, so that those of one file go to many tasks.
    return short.mapInArrow(decode, schema).unionByName(ranges.repartition("path", "at").mapInArrow(fetch, schema))


def write_array(df: DataFrame, path: str, dtype: str = "int32") -> int:
    """df(idx long, value) as a folder of raw parts in idx order; gives the number of elements.

    Tasks write to a name of their own and then rename, so a repeated task leaves one part.
    """
    if not path.rstrip("/").endswith(".bin"):
        raise ValueError("the folder of an array ends in .bin")

    def store(batches):
        fs, root = _opened(path)
        part = TaskContext.get().partitionId()
        fs.create_dir(root, recursive=True)
        draft, n = f"{root}/_{uuid.uuid4().hex}", 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                values = batch.column("value").to_numpy(zero_copy_only=False).astype(dtype)
                out.write(values.tobytes())
                n += len(values)
        if n:
            fs.move(draft, f"{root}/part-{part:06d}.bin")
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    done = df.select("idx", "value").repartitionByRange("idx").sortWithinPartitions("idx").mapInArrow(store, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_reorder_map(spark: SparkSession, path: str) -> DataFrame:
    """(new_row, old_row) from an int32 array."""
    return read_array(spark, path, "int32").select(F.col("idx").alias("new_row"), F.col("value").cast("long").alias("old_row"))
