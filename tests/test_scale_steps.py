"""What keeps the matrix queries' steps from growing faster than their input: plans, partitions, and the paths for long windows."""

import random

import numpy as np
import pytest

from jobs import matrix_blocks
from tessera.operators import layout, reorder, spmm
from tessera.plans import reference_queries
from tessera.sources import matrix_market
from tessera.streaming import incremental

SF = "/root/testdata/sf0.001"
COO = "row long, col long, val double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_entries(spark, n=400, rows=50, cols=300):
    draw = random.Random(5)
    return spark.createDataFrame(sorted({(draw.randrange(rows), draw.randrange(cols)): float(draw.randrange(1, 9)) for _ in range(n)}.items()), "at struct<row long, col long>, val double").select("at.*", "val")


def written(spark, path, symmetry="general"):
    a = some_entries(spark).filter("row >= col") if symmetry != "general" else some_entries(spark)
    matrix_market.write_mtx(a.repartition(5), f"{path}/c/m.mtx", 300, 300, symmetry)
    return a, str(path)


def test_matrix_lines_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    a, path = written(spark, tmp_path)
    entries = matrix_market.read_mtx(spark, path)[0]
    assert "SortMergeJoin" not in plan(entries)
    want = sorted(map(tuple, a.collect()))
    assert sorted(map(tuple, entries.select("row", "col", "val").collect())) == want
    monkeypatch.setattr(matrix_market, "BROADCAST_PARTS", 0)
    assert sorted(map(tuple, matrix_market.read_mtx(spark, path)[0].select("row", "col", "val").collect())) == want


def test_matrix_lines_are_counted_without_a_sort(spark, tmp_path):
    _, path = written(spark, tmp_path)
    meta = matrix_market.read_mtx(spark, path)[1]
    counted = [line for line in plan(meta).splitlines() if "Aggregate(" in line and "count(1)" in line]
    assert counted and not [line for line in counted if "SortAggregate" in line]


def test_mirrored_entries_come_from_one_reading(spark, tmp_path):
    a, path = written(spark, tmp_path, "skew-symmetric")
    both, one = (matrix_market.read_mtx(spark, path, expand_symmetry=x)[0] for x in (True, False))
    # The banners are read for the symmetry only.
    assert plan(both).count("FileScan text") == plan(one).count("FileScan text") + 1
    half = [tuple(r) for r in a.collect()]
    assert sorted(map(tuple, both.select("row", "col", "val").collect())) == sorted(half + [(c, r, -v) for r, c, v in half if r != c])


@pytest.mark.parametrize("limit", [1 << 16, 20, 0])
def test_condensed_cells_by_one_sort(spark, monkeypatch, limit):
    a = some_entries(spark).union(some_entries(spark).limit(30)).union(spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0)], COO))
    monkeypatch.setattr(layout, "LONG_WINDOW", limit)
    cells = layout.condensed_cells(a)
    if limit > 400:
        assert "Join" not in plan(cells)
    want, windows = {}, {}
    for r, c, v in a.dropna().collect():
        want[r, c] = want.get((r, c), 0.0) + v
        windows.setdefault(r // 16, set()).add(c)
    place = {w: {c: i for i, c in enumerate(sorted(cs))} for w, cs in windows.items()}
    assert sorted(map(tuple, cells.collect())) == sorted((r // 16, place[r // 16][c] // 16, r % 16 * 16 + place[r // 16][c] % 16, c, v) for (r, c), v in want.items())


@pytest.mark.parametrize(("shared", "chunk", "n"), [(True, 1, 11), (False, 1, 11), (False, 32 << 20, 3)])
def test_blocked_product_multiplies_blocks_together(spark, monkeypatch, shared, chunk, n):
    a, b = some_entries(spark), spmm.dense_b_rows(spark, 300, n)
    monkeypatch.setattr(spmm, "CHUNK_BYTES", chunk)
    if not shared:
        monkeypatch.setattr(spmm, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(spmm, "PART_BLOCKS", 2)
    c = spmm.spmm_blocked(a, b, 300, n)
    assert plan(c).count("Join") == (not shared)
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, spmm.spmm_formula(a, n).collect()))


def test_tiled_product_has_partitions_by_size(spark, monkeypatch):
    a, b = some_entries(spark), spmm.dense_b_rows(spark, 300, 6)
    monkeypatch.setattr(spmm, "PARTITION_BYTES", 1 << 10, raising=False)
    c = spmm.spmm_tiled(a, b, 6, tile_bytes=1 << 10)
    assert c.rdd.getNumPartitions() == -(-a.count() * 6 * 8 // 1024)
    assert {(r, i): v for r, x in c.collect() for i, v in enumerate(x)} == {(r, i): v for r, i, v in spmm.spmm_formula(a, 6).collect()}


def test_digests_are_made_where_blocks_are_filled(spark):
    for q in (reference_queries.bcsr_values, reference_queries.condensed_blocks):
        assert "Generate" not in plan(q(spark, SF))
    a = some_entries(spark)
    for r in layout.bcsr_values(a).join(layout.bcsr_values(a, then=layout.BLOCK_SUMS), ["rw", "bc"]).collect():
        assert (r["cells"], r["total"], r["weighted"]) == (len(r["vals"]), sum(r["vals"]), sum(i * v for i, v in enumerate(r["vals"])))
    blocks = layout.condensed_blocks(a)
    assert sorted(map(tuple, layout.stored_cells(blocks).collect())) == sorted(map(tuple, layout.condensed_blocks(a, then=layout.STORED_CELLS).collect()))


def test_golden_product_is_made_once(spark):
    assert "l_partkey" not in plan(reference_queries.verify_mismatches(spark, SF))


def test_no_filled_block_is_joined(spark, tmp_path, monkeypatch):
    seen = []
    write = matrix_blocks._write
    monkeypatch.setattr(matrix_blocks, "_write", lambda df, *more: (seen.append(plan(df)), write(df, *more)))
    matrix_blocks.run(spark, f"{SF}/documents.parquet", str(tmp_path / "out"))
    before_fill = seen[0][: seen[0].index("MapInArrow")]
    assert "Join" not in before_fill and "Exchange" not in before_fill


def test_tiled_vectors_travel_as_bytes(spark):
    a, b = some_entries(spark), spmm.dense_b_rows(spark, 300, 6)
    assert "packed" in plan(spmm.spmm_tiled(a, b, 6, tile_bytes=1 << 10))
    sums = np.arange(12.0).reshape(3, 4)
    whole = spmm._packed([5, 6, 7], sums).column("packed")
    assert (spmm._unpacked(whole, 4) == sums).all() and (spmm._unpacked(whole.slice(1), 4) == sums[1:]).all()


def test_followed_matrix_keeps_no_state(spark, tmp_path):
    """The log alone has the newest entries: a stream's state would hold a row for each place in the executors' memory."""
    path = str(tmp_path)
    new = lambda rows: spark.createDataFrame(rows, "row long, col long, val double, seq long").write.mode("append").parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema("row long, col long, val double, seq long").parquet(f"{path}/in")
    new([(1, 1, 5.0, 9), (1, 2, 3.0, 1), (2, 2, 4.0, 1)])
    incremental.follow(stream(), f"{path}/log", f"{path}/mark")
    new([(1, 1, 7.0, 2), (1, 2, 8.0, 2)])
    incremental.follow(stream(), f"{path}/log", f"{path}/mark")
    assert sorted(map(tuple, incremental.current(spark, f"{path}/log").collect())) == [(1, 1, 5.0), (1, 2, 8.0), (2, 2, 4.0)]
    assert not (tmp_path / "mark" / "state").exists()


def test_recall_counts_stand_one_by_one(spark):
    """No threshold's search waits in the plan of the result, with its shuffles beside the others'."""
    assert "Join" not in plan(reference_queries.lsh_recall(spark, SF))


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_cells_past_a_rows_need_are_not_sent(spark, threshold):
    a = some_entries(spark, n=500, rows=90, cols=40)
    a = a.union(a.filter("row % 7 = 0").selectExpr("row + 200", "col", "val"))
    rows = {}
    for r, c, _ in a.collect():
        rows.setdefault(r, set()).add(c)
    want = {(i, j) for i in rows for j in rows if i < j and len(rows[i] & rows[j]) / len(rows[i] | rows[j]) >= threshold}
    sets = reorder.column_sets(a.select("row", "col").distinct())
    assert want and {tuple(r) for r in reorder.jaccard_pairs(a, threshold, sets=sets).select("i", "j").collect()} == want


def test_counted_words_are_not_added_up_again(spark, tmp_path, monkeypatch):
    seen = []
    write = matrix_blocks._write
    monkeypatch.setattr(matrix_blocks, "_write", lambda df, *more: (seen.append(plan(df)), write(df, *more)))
    matrix_blocks.run(spark, f"{SF}/documents.parquet", str(tmp_path / "out"))
    assert "sum(val" not in seen[0]
    a = some_entries(spark)
    assert sorted(map(tuple, layout.condensed_cells(a, unique=True).collect())) == sorted(map(tuple, layout.condensed_cells(a).collect()))
