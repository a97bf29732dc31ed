"""Derived layouts: row-compressed, blocked, and column-condensed blocks."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import BLOCK, ceil_div, div_floor, fill_fraction, fill_mean, fill_per_block
from tessera.functions.prefix import running_start
from tessera.functions.store import stored

#: Entries of a window of rows that one task numbers; the columns of longer windows are numbered in ranges.
LONG_WINDOW = 1 << 16


def csr_row_ptr(coo: DataFrame) -> DataFrame:
    """(row, nnz, start) for the rows that hold entries."""
    return running_start(coo.groupBy("row").agg(F.count("*").alias("nnz")), "row", "nnz", "start")


def to_csr(coo: DataFrame) -> DataFrame:
    """(row, entries array<struct<col,val>>), entries sorted by column then value."""
    return coo.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("entries"))


def from_csr(csr: DataFrame) -> DataFrame:
    return csr.select("row", F.explode("entries").alias("e")).select("row", "e.col", "e.val")


def bcsr_blocks(coo: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rw, bc, col_start, nnz): uncondensed blocks that hold at least one stored entry."""
    return (
        coo.groupBy(div_floor(F.col("row"), block).alias("rw"), div_floor(F.col("col"), block).alias("bc"))
        .agg(F.count("*").alias("nnz"))
        .withColumn("col_start", F.col("bc") * block)
    )


def bcsr_values(coo: DataFrame, block: int = BLOCK, then: "Then | None" = None) -> DataFrame:
    """(rw, bc, vals array<double>): dense row-major values of each uncondensed block, or what `then` makes of them.

    Repeated coordinates are added up first.
    """
    cells = coo.groupBy("row", "col").agg(F.sum("val").alias("val")).select(
        div_floor(F.col("row"), block).alias("rw"),
        div_floor(F.col("col"), block).alias("bc"),
        ((F.col("row") % block) * block + F.col("col") % block).cast("int").alias("off"),
        "val",
    )
    return _dense(cells, ["rw", "bc"], block, False, then)


#: A function of (batch, cols, vals) that gives a batch, and its schema: filled blocks are reduced in the task that fills them.
Then = tuple[Callable[[pa.RecordBatch, np.ndarray | None, np.ndarray], pa.RecordBatch], str]


def _dense(cells: DataFrame, keys: list[str], block: int, gather: bool, then: Then | None = None) -> DataFrame:
    """keys + vals, the dense row-major values of each block; with `gather`, cols before it: the column at each of the block's places.

    A block has block*block cells at most, so the collected list is bounded.
    Places after the block's last column repeat that column. Arrays of many
    blocks are filled at once in NumPy.
    """
    names, size = ["off", "val", *(["col"] if gather else [])], block * block
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("cells"))

    def fill(batches):
        for batch in batches:
            n = batch.num_rows
            lists = batch.column("cells")
            flat = lists.flatten()
            block_of = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            off = flat.field("off").to_numpy()
            vals = np.zeros(n * size)
            vals[block_of * size + off] = flat.field("val").fill_null(0.0).to_numpy()
            out, cols = [batch.column(k) for k in keys], None
            if gather:
                cols = np.full((n, block), np.iinfo(np.int64).min)
                cols[block_of, off % block] = flat.field("col").to_numpy()
                cols = np.maximum.accumulate(cols, axis=1)
                out.append(_lists(cols, block))
            if then:
                yield then[0](pa.RecordBatch.from_arrays(out[: len(keys)], keys), cols, vals.reshape(n, size))
                continue
            yield pa.RecordBatch.from_arrays([*out, _lists(vals, size)], [*keys, *(["cols"] if gather else []), "vals"])

    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *(["cols array<long>"] if gather else []), "vals array<double>"])
    return packed.mapInArrow(fill, then[1] if then else schema)


def _lists(values: np.ndarray, size: int) -> pa.ListArray:
    """Lists of `size` values each."""
    flat = values.reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))


def condensed_positions(coo: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rw, col, pos): place of each distinct column among its window's sorted columns."""
    cols = coo.select(div_floor(F.col("row"), block).alias("rw"), "col").distinct()
    return running_start(cols.withColumn("one", F.lit(1)), "col", "one", "pos", by=["rw"]).select("rw", "col", "pos")


def condensed_window_blocks(coo: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rw, ncols, nblocks, start): blocks of each window and the running block number."""
    return running_start(window_sizes(coo, block), "rw", "nblocks", "start")


def window_sizes(coo: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rw, ncols, nblocks): distinct columns and condensed blocks of each window."""
    return (
        coo.select(div_floor(F.col("row"), block).alias("rw"), "col")
        .distinct()
        .groupBy("rw")
        .agg(F.count("*").alias("ncols"))
        .withColumn("nblocks", ceil_div(F.col("ncols"), block))
    )


def gather_list(coo: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rw, blk, slot, col): the column that each slot of a condensed block gathers.

    Slots after the window's last column repeat that column.
    """
    pos = condensed_positions(coo, block)
    placed = pos.select("rw", div_floor(F.col("pos"), block).alias("blk"), (F.col("pos") % block).alias("slot"), "col")
    per_block = placed.groupBy("rw", "blk").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(block - 1)),
        lambda i: F.element_at("cols", F.least(i + 1, F.size("cols")).cast("int")),
    )
    return per_block.select("rw", "blk", F.posexplode(slots).alias("slot", "col"))


def condensed_cells(coo: DataFrame, block: int = BLOCK, unique: bool = False) -> DataFrame:
    """(rw, blk, off, col, val): entries at their place in condensed blocks; repeats added up, unless places are known to be `unique`.

    A window's columns are numbered by one sort of its entries. Windows of more
    than LONG_WINDOW entries are counted first and take their places from
    condensed_positions, so none is a single task's.
    """
    held = coo.dropna(subset=["row", "col"])
    window = div_floor(F.col("row"), block)
    added = held.select("row", "col", "val") if unique else held.groupBy("row", "col").agg(F.sum("val").alias("val"))
    cells = added.withColumn("rw", window)
    long = held.groupBy(window.alias("rw")).agg(F.count("*").alias("_n")).filter(F.col("_n") > LONG_WINDOW).select("rw")
    ranked = lambda part: part.withColumn("pos", F.dense_rank().over(Window.partitionBy("rw").orderBy("col")) - 1)
    if long.isEmpty():
        placed = ranked(cells)
    else:
        long = F.broadcast(stored(long))
        of_long = held.withColumn("rw", window).join(long, "rw", "left_semi")
        by_range = cells.join(long, "rw", "left_semi").join(condensed_positions(of_long, block), ["rw", "col"])
        placed = ranked(cells.join(long, "rw", "left_anti")).unionByName(by_range)
    return placed.select(
        "rw",
        div_floor(F.col("pos"), block).alias("blk"),
        ((F.col("row") % block) * block + F.col("pos") % block).cast("int").alias("off"),
        "col",
        "val",
    )


def condensed_blocks(coo: DataFrame, block: int = BLOCK, then: Then | None = None) -> DataFrame:
    """(rw, blk, cols array<long>, vals array<double>): condensed blocks with their gather lists, or what `then` makes of them."""
    return gathered_blocks(condensed_cells(coo, block), ["rw", "blk"], block, then)


def gathered_blocks(cells: DataFrame, keys: list[str], block: int = BLOCK, then: Then | None = None) -> DataFrame:
    """keys + cols, vals of condensed cells, which may carry more keys than rw and blk."""
    return _dense(cells, keys, block, True, then)


def _cells_of(batch: pa.RecordBatch, cols: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    """Keys, off, col and val of each value that is not 0."""
    at, off = np.nonzero(vals)
    kept = [c.take(pa.array(at)) for c in batch.columns]
    return pa.RecordBatch.from_arrays([*kept, pa.array(off), pa.array(cols[at, off % cols.shape[1]]), pa.array(vals[at, off])], [*batch.schema.names, "off", "col", "val"])


def _sums_of(batch: pa.RecordBatch, cols: None, vals: np.ndarray) -> pa.RecordBatch:
    """Keys, how many values a block has, their sum, and their sum weighted by place."""
    n, size = vals.shape
    sums = [pa.array(np.full(n, size, np.int32)), pa.array(vals.sum(axis=1)), pa.array((vals * np.arange(size)).sum(axis=1))]
    return pa.RecordBatch.from_arrays([*batch.columns, *sums], [*batch.schema.names, "cells", "total", "weighted"])


#: For condensed_blocks, their stored cells; for bcsr_values, their sums.
STORED_CELLS: Then = (_cells_of, "rw long, blk long, off long, col long, val double")
BLOCK_SUMS: Then = (_sums_of, "rw long, bc long, cells int, total double, weighted double")


def stored_cells(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of written blocks(..., cols, vals): their other columns, off long, col, the column gathered there, and val, for each value that is not 0."""
    keys = [c for c in blocks.columns if c not in ("cols", "vals")]
    kinds = dict(blocks.dtypes)

    def cells(batches):
        for batch in batches:
            cols, vals = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("cols", block), ("vals", block * block)))
            yield _cells_of(batch.select(keys), cols, vals)

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "off long, col long, val double"])
    return blocks.select(*keys, "cols", "vals").mapInArrow(cells, schema)


def fill_rates(coo: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row with the block counts of both layouts and the three fill rates in use."""
    nnz = coo.agg(F.count("*").alias("nnz"))
    plain = bcsr_blocks(coo, block).agg(F.count("*").alias("blocks"))
    cond = condensed_window_blocks(coo, block).agg(F.coalesce(F.sum("nblocks"), F.lit(0)).alias("condensed_blocks"))
    n, b, c = F.col("nnz"), F.col("blocks"), F.col("condensed_blocks")
    return nnz.join(plain).join(cond).select(
        n,
        b,
        c,
        fill_fraction(n, b).alias("fill_fraction"),
        fill_mean(n, c).alias("fill_mean"),
        fill_per_block(n, c).alias("fill_per_block"),
    )
