"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is named and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession) -> str:
    """A place for a new table, in a folder of this application below `tables`."""
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Where each stored table lies, by the DataFrame that reads it.
_places: dict[int, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors.

    `dropped` deletes tables that no result reads; the folder's owner deletes the rest.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = path
    weakref.finalize(out, _places.pop, id(out), None)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes stored tables. Nothing that is still to be computed may read them."""
    for t in tables:
        path = _places.pop(id(t), None) if t is not None else None
        if path:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
