"""Matrix Market coordinate text.

A matrix is a file `name.mtx` or, as Spark writes text, a folder `name.mtx` of
part files in order of their names.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.joins import spread_join

# The banner's word and the symmetries that store one triangle, with the sign of the other one.
BANNER = "%%matrixmarket"
SIGNS = {"symmetric": 1.0, "hermitian": 1.0, "skew-symmetric": -1.0}
#: Part files whose names and headers are broadcast.
BROADCAST_PARTS = 100_000


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, n, line) of all matrices below path; these three in order place a line within its matrix.

    Files are read as splittable text; a line is placed by its part, its split's
    start and its place in the split.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{*.mtx,part-*}")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"),
            F.btrim("value", F.lit(" \t\r")).alias("line"),
        )
        .filter(F.col("line") != "")
    )


def named(parts: DataFrame) -> DataFrame:
    """parts(part, ...) of matrices, with their file, category and matrix."""
    files = parts.withColumn("file", F.regexp_extract("part", r"^(.*?\.mtx)(?:/[^/]*)?$", 1))
    files = files.filter((F.col("file") != "") & ~F.col("file").contains("/.ipynb_checkpoints/"))
    return files.withColumns({"category": F.regexp_extract("file", r"([^/]*)/[^/]*$", 1), "matrix": F.regexp_extract("file", r"([^/]*)\.mtx$", 1)})


def read_mtx(spark: SparkSession, path: str, expand_symmetry: bool = False, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, meta): entries(file, category, matrix, row, col, val) 0-based, meta(file, category, matrix, m, k, nnz, symmetry, stored).

    Matrices are told apart by their file, so equal names don't mix. The first
    line that is no comment is the header and needs three numbers. Two-column
    entries get the value 1; any other width is an error. With `check` both
    tables raise where a matrix does not hold the entries that its header says.
    The banner's symmetry is ignored unless expand_symmetry is set, which adds
    the mirrored entries of symmetric, Hermitian and skew-symmetric matrices.

    Lines are counted by split and stay where they are read: what a matrix's
    header says comes to them by the part's name.
    """
    raw = raw_lines(spark, path)
    # Up to so many parts their rows are broadcast, else the lines are shuffled.
    few = len(raw.inputFiles()) <= BROADCAST_PARTS
    lines = raw.filter(~F.col("line").startswith("%"))
    banners = raw.filter(F.col("line").startswith("%") & F.lower("line").startswith(BANNER))
    banners = named(banners).groupBy("file").agg(F.element_at(F.split(F.lower(F.min_by("line", F.struct("part", "at", "n"))), r"\s+"), -1).alias("symmetry"))
    splits = named(lines.groupBy("part", "at").agg(F.min("n").alias("n"), F.count("*").alias("lines")))
    heads = splits.groupBy("file", "category", "matrix").agg(F.min(F.struct("part", "at", "n")).alias("seq"), (F.sum("lines") - 1).alias("stored"))
    heads = heads.select("file", "category", "matrix", F.col("seq.n").alias("head"), "stored")
    first = lines.select("n", "line").join(F.broadcast(heads) if few else heads, F.col("n") == F.col("head")).withColumn("tok", F.split("line", r"\s+"))
    number = lambda i, kind: F.col("tok")[i].cast(kind)
    stored = F.col("stored")
    if check:
        differs = F.concat(F.lit("entries differ from the header in "), F.col("file"))
        stored = F.when(stored != number(2, "long"), F.raise_error(differs).cast("long")).otherwise(stored)
    bad_head = F.when(F.size("tok") < 3, F.raise_error(F.lit("the header needs M K nnz")).cast("long"))
    meta = first.join(F.broadcast(banners) if few else banners, "file", "left").select(
        "file", "category", "matrix", F.coalesce(bad_head, number(0, "long")).alias("m"), number(1, "long").alias("k"), number(2, "long").alias("nnz"),
        F.coalesce("symmetry", F.lit("general")).alias("symmetry"), stored.alias("stored"), "head",
    )
    of_file = meta.filter("stored >= 0").select("file", "category", "matrix", "head", "symmetry")
    parts = splits.select("file", "part").distinct().join(F.broadcast(of_file) if few else of_file, "file")
    body = (lines.join(F.broadcast(parts), "part") if few else spread_join(lines, parts, "part")).filter(F.col("n") != F.col("head")).withColumn("tok", F.split("line", r"\s+"))
    wrong = F.raise_error(F.concat(F.lit("an entry needs 2 or 3 columns: "), F.concat_ws(" ", "tok")))
    val = F.when(F.size("tok") == 3, number(2, "double")).when(F.size("tok") == 2, F.lit(1.0)).otherwise(wrong.cast("double"))
    entries = body.select("file", "category", "matrix", (number(0, "long") - 1).alias("row"), (number(1, "long") - 1).alias("col"), val.alias("val"), "symmetry")
    if expand_symmetry:
        # Both of a pair from one reading of the line.
        sign = F.when(F.col("symmetry") == "skew-symmetric", F.lit(-1.0)).otherwise(F.lit(1.0))
        own, other = F.struct("row", "col", "val"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val"))
        both = F.when(F.col("symmetry").isin(*SIGNS) & (F.col("row") != F.col("col")), F.array(own, other)).otherwise(F.array(own))
        entries = entries.select("file", "category", "matrix", F.inline(both), "symmetry")
    return entries.drop("symmetry"), meta.drop("head")


def write_mtx(coo: DataFrame, path: str, m: int, k: int, symmetry: str = "general") -> None:
    """A matrix as a folder `name.mtx` of text parts in row order; indices from 1. A symmetric one is given by one triangle."""
    cells = coo.select(F.lit(2).alias("part"), "row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "val").alias("line"))
    size = coo.agg(F.count("*").alias("nnz")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.concat_ws(" ", F.lit(m), F.lit(k), "nnz").alias("line"))
    banner = coo.sparkSession.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate real {symmetry}")], "part int, row long, col long, line string")
    banner.unionByName(size).unionByName(cells).orderBy("part", "row", "col").select("line").write.mode("overwrite").text(path)
