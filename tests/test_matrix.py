import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_row_orders import kruskal, plain_merge, plain_walk

from tessera.functions import prefix
from tessera.functions.numeric import ceil_div, div_floor, round_exact, round_f16, round_up
from tessera.operators import coo as C
from tessera.operators import layout, partition, perf, reorder, spmm, verify
from tessera.sources import binary, logs, matrix_market, sinks
from tessera.streaming import incremental

COO = "row long, col long, val double"
F1 = [(0, 0, 2.0), (0, 17, 3.0), (2, 17, -1.5), (1, 4, 4.0)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tiny_matrix(spark):
    a = spark.createDataFrame(F1, COO)
    assert rows(layout.csr_row_ptr(a), "row", "start", "nnz") == [(0, 0, 2), (1, 2, 1), (2, 3, 1)]
    assert rows(layout.bcsr_blocks(a), "rw", "col_start") == [(0, 0), (0, 16)]
    block = layout.condensed_blocks(a).collect()
    assert len(block) == 1 and block[0]["cols"] == [0, 4] + [17] * 14
    assert {i: v for i, v in enumerate(block[0]["vals"]) if v} == {0: 2.0, 2: 3.0, 17: 4.0, 34: -1.5}
    fill = layout.fill_rates(a).first()
    assert (fill["fill_fraction"], fill["fill_mean"], fill["fill_per_block"]) == (0.01, 5.12, 4.0)
    c = {r["row"]: r["val"] for r in spmm.spmm(a, spmm.dense_b(spark, 20, 4)).filter("n = 0").collect()}
    assert c == {0: 26.0, 1: 20.0, 2: -12.0}
    assert spmm.dense_grid(spmm.spmm_formula(a, 2), 5, 2).count() == 10
    assert rows(layout.from_csr(layout.to_csr(a)), "row", "col", "val") == sorted(F1)


def test_duplicates_and_bounds(spark):
    a = spark.createDataFrame([(0, 0, 2.0, 1), (0, 0, 5.0, 2)], COO + ", line int")
    assert C.dedup(a).first()["val"] == 7 and C.dedup(a, "last", ["line"]).first()["val"] == 5
    with pytest.raises(ValueError):
        C.dedup(a, "last")
    b = spark.createDataFrame([(0, 0, 1.0), (-1, 0, 1.0), (0, 9, 1.0)], COO)
    assert C.within_bounds(b, 3, 3).count() == 1 and C.count_out_of_bounds(b, 3, 3).first()["dropped"] == 2
    assert C.expand_symmetry(spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], COO)).count() == 3


def test_f16(spark):
    xs = [0.1, 2049.0, 65519.9, 65520.0, 2.0**-25, -3.3, 0.0] + [random.Random(1).uniform(-1e5, 1e5) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(round_f16(F.col("x"))).collect()
    with np.errstate(over="ignore"):
        assert [r[0] for r in got] == [float(np.float16(x)) for x in xs]


@pytest.mark.parametrize(
    "cores,want",
    [
        (2, [(0, 1, 0, 3), (1, 3, 0, 2)]),
        (4, [(0, 1, 0, 2), (0, 1, 2, 3), (1, 3, 0, 1), (2, 3, 1, 2)]),
        (6, [(0, 1, 0, 1), (0, 1, 1, 2), (0, 1, 2, 3), (1, 3, 0, 1), (2, 3, 1, 2), (3, 3, 0, 0)]),
    ],
)
def test_core_split(spark, cores, want):
    w = spark.createDataFrame([(0, 3), (1, 0), (2, 2)], "rw long, nblocks long")
    got = partition.core_split(w, cores).orderBy("core").collect()
    assert [tuple(r)[1:] for r in got] == want


def test_random_products_agree(spark, monkeypatch):
    rng = random.Random(7)
    entries = [(rng.randrange(70), rng.randrange(53), float(rng.randrange(-3, 4))) for _ in range(400)]
    a = spark.createDataFrame(entries, COO)
    dense = np.zeros((70, 53))
    for r, c, v in entries:
        dense[r, c] += v
    b = np.array([[1 + (31 * k + 17 * n) % 10 for n in range(5)] for k in range(53)], float)
    want = dense @ b
    bl = spmm.dense_b(spark, 53, 5)
    br = spmm.dense_b_rows(spark, 53, 5)
    for c in (spmm.spmm(a, bl), spmm.spmm_rows(a, br), spmm.spmm_formula(a, 5), spmm.spmm_blocked(a, br, 53, 5)):
        for r in c.collect():
            assert want[r["row"], r["n"]] == r["val"]
    for limit, heavy in ((spmm.BROADCAST_BYTES, spmm.HEAVY_ROW), (0, spmm.HEAVY_ROW), (0, 3)):
        monkeypatch.setattr(spmm, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(spmm, "HEAVY_ROW", heavy)
        wide = spmm.spmm_rowvec(a, br, 53, 5).collect()
        assert {(r["row"], r["n"]): r["val"] for r in spmm.spmm_blocked(a, br, 53, 5).collect()} == {(r["row"], n): x for r in wide for n, x in enumerate(r["c"])}
        assert len(wide) == len({e[0] for e in entries})
        for r in wide:
            assert list(want[r["row"]]) == r["c"]
    order = reorder.mkst_order(a, 70)
    back = C.restore_rows(spmm.spmm_formula(C.permute_rows(a, order), 5), order)
    assert rows(back, "row", "n", "val") == rows(spmm.spmm_formula(a, 5), "row", "n", "val")
    windows = layout.condensed_window_blocks(a).join(layout.bcsr_blocks(a).groupBy("rw").count(), "rw")
    assert windows.filter(F.col("nblocks") > F.col("count")).count() == 0
    blocks = {(r["rw"], r["bc"]): r["vals"] for r in layout.bcsr_values(a).collect()}
    assert set(blocks) == {(r // 16, c // 16) for r, c, _ in entries}
    grid = np.pad(dense, ((0, 10), (0, 11)))
    for (rw, bc), vals in blocks.items():
        assert vals == list(grid[rw * 16 : rw * 16 + 16, bc * 16 : bc * 16 + 16].ravel())


def test_empty_matrix(spark):
    a = spark.createDataFrame([], COO)
    assert spmm.spmm_formula(a, 3).count() == 0
    assert spmm.dense_grid(spmm.spmm_formula(a, 3), 5, 3).agg(F.sum("val")).first()[0] == 0
    assert layout.fill_rates(a).first()["fill_per_block"] == 0
    w = spark.createDataFrame([(0, 0)], "rw long, nblocks long")
    assert [tuple(r)[1:] for r in partition.core_split(w, 2).orderBy("core").collect()] == [(1, 1, 0, 0)] * 2


def test_similarity(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 17, 1.0), (1, 0, 1.0), (1, 4, 1.0), (1, 17, 1.0), (2, 9, 1.0)], COO)
    assert [(r["i"], r["j"]) for r in reorder.jaccard_pairs(a).collect()] == [(0, 1)]
    assert [r["old_row"] for r in reorder.mkst_order(a, 4).orderBy("new_row").collect()] == [0, 1, 2, 3]
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "new_row long, old_row long")
    c = spark.createDataFrame([(0, 0, 2.0), (1, 0, 0.0), (2, 0, 1.0)], "row long, n int, val double")
    assert rows(C.restore_rows(c, order), "row", "val") == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert C.pad_rows(order, 3, 16).count() == 16


def test_tolerance(spark):
    g = [100.0, 100.0, 0.0, 0.0, math.nan, math.inf]
    o = [100.005, 100.02, 5e-7, 2e-6, math.nan, math.inf]
    mk = lambda v: spark.createDataFrame([(i, 0, x) for i, x in enumerate(v)], "row long, n int, val double")
    assert verify.verify(mk(o), mk(g)).first()["mismatches"] == 2
    assert [r["row"] for r in verify.mismatches(mk(o), mk(g)).collect()] == [1]
    signs = verify.mismatches(mk([90.0, 110.0, -90.0]), mk([100.0, 100.0, -100.0])).orderBy("row").collect()
    assert [r["rdiff"] for r in signs] == [0.1, 0.1, -0.1]
    assert rows(verify.dump_grid(mk([1.25, -3.0]), 1), "line") == [("   1.2",), ("  -3.0",)]


def test_perf_compare(spark):
    mk = lambda d: spark.createDataFrame([("c", k, v) for k, v in d.items()], "category string, sample string, perf_us double")
    base, opt = mk({"X": 12.0, "Y": 10.0, "Z": 5.0}), mk({"X": 8.0, "Y": 10.02, "W": 1.0})
    s = perf.summary(perf.compare(base, opt)).first()
    assert (s["improved"], s["unchanged"], round(s["total_ratio"], 3), round(s["median_speedup"], 3)) == (1, 1, 1.221, 1.249)
    assert rows(perf.only_one_side(base, opt), "sample", "side") == [("W", "opt"), ("Z", "base")]
    assert [r["sample"] for r in perf.sort_report(perf.compare(base, opt), "abs").collect()] == ["X", "Y"]
    wide = "category string, sample string, m long, block_num long, perf_us double"
    base = spark.createDataFrame([("b", "X", 1, 5, 4.0), ("a", "Y", 2, 9, 6.0), ("a", "Z", 3, 7, 1.0)], wide)
    opt = spark.createDataFrame([("b", "X", 1, 5, 0.0), ("a", "Y", 2, 9, 3.0), ("a", "Z", 3, 7, 2.0)], wide)
    found = perf.compare(base, opt)
    by = lambda key: [r["sample"] for r in perf.sort_report(found, key).collect()]
    assert (by("speedup"), by("abs"), by("sample"), by("blocks")) == (["X", "Y", "Z"], ["X", "Y", "Z"], ["Y", "Z", "X"], ["Y", "Z", "X"])
    assert [(r["speedup"], r["verdict"]) for r in perf.sort_report(found, "sample").collect()] == [(2.0, "improved"), (0.5, "regressed"), (math.inf, "improved")]
    lines = [r["line"] for r in perf.compare_report(found, base, opt, "blocks").collect()]
    assert [x.split()[1] for x in lines[2:5]] == ["Y", "Z", "X"] and lines[6] == "samples: 3" and "ratio=2.200x" in lines[8]
    with pytest.raises(ValueError):
        perf.sort_report(found, "other")


def test_valid_times(spark):
    t = spark.createDataFrame([(x,) for x in (0.0, 2.0, 4.0, -1.0, math.nan, math.inf, None)], "perf_us double")
    assert (perf.valid(t).count(), perf.valid(t, True).count()) == (2, 3)


def test_category_report(spark):
    t = spark.createDataFrame([("b", "y", 2.0), ("a", "z", 4.0), ("b", "x", 2.0), ("b", "x", 1.0)], "category string, sample string, perf_us double")
    assert [(r["category"], r["place"], r["sample"], r["perf_us"]) for r in perf.ordered(t).collect()] == [("a", 1, "z", 4.0), ("b", 1, "x", 1.0), ("b", 2, "x", 2.0), ("b", 3, "y", 2.0)]
    lines = [r["line"].split() for r in perf.category_report(t).collect()]
    assert lines[1][0] == "category" and lines[3] == ["a", "1", "4.00", "4.00", "44.44"] and lines[6] == ["total", "4", "9.00", "2.25", "100.00"]


def test_ids_beyond_doubles(spark):
    ids = [0, 15, 16, 2**53 + 31, 2**58 - 1, 2**60 + 3, 2**62 + 17]
    got = spark.createDataFrame([(i,) for i in ids], "x long").select(div_floor(F.col("x"), 16), ceil_div(F.col("x"), 16), round_up(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(i // 16, -(-i // 16), -(-i // 16) * 16) for i in ids]
    a = spark.createDataFrame([(2**53 + 31, 2**58 - 1, 1.0), (2**53 + 32, 2**58, 2.0)], COO)
    assert rows(layout.bcsr_blocks(a), "rw", "bc", "nnz") == [((2**53 + 31) // 16, (2**58 - 1) // 16, 1), ((2**53 + 32) // 16, 2**58 // 16, 1)]
    assert rows(layout.csr_row_ptr(a), "row", "start") == [(2**53 + 31, 0), (2**53 + 32, 1)]


def test_running_start_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix, "STRIDE", 4)
    rng = random.Random(3)
    data = [(g, k, rng.randrange(9)) for g in range(3) for k in rng.sample(range(40), 15)]
    df = spark.createDataFrame(data, "g int, k long, v int")
    want = sorted((g, k, sum(v for h, q, v in data if h == g and q < k)) for g, k, _ in data)
    assert rows(prefix.running_start(df, "k", "v", "s", by=["g"]), "g", "k", "s") == want


def test_exact_rounding(spark):
    xs = [3.0625, 1.1625, 1.6125, 0.4625, 2.675, -2.675, 0.0005, 147 / 48, 1e9 + 0.0005] + [random.Random(5).randrange(1, 2000) / random.Random(i).randrange(1, 800) for i in range(300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(round_exact(F.col("x"), 3)).collect()
    assert [f"{r[0]:.3f}" for r in got] == [f"{x:.3f}" for x in xs]


def test_stored_zeros(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (5, 3, 0.0)], COO)
    c = spmm.spmm_blocked(a, spmm.dense_b_rows(spark, 4, 2), 4, 2)
    assert rows(c, "row", "n", "val") == rows(spmm.spmm(a, spmm.dense_b(spark, 4, 2)), "row", "n", "val") == [(0, 0, 1.0), (0, 1, 8.0), (5, 0, 0.0), (5, 1, 0.0)]


@pytest.mark.parametrize("values", [[], [3.5], [1.0, 2.0], [2.0] * 7, [float("inf"), 1.0, 2.0], [float("inf")] * 3 + [0.5], [float("-inf"), float("inf"), 4.0, 5.0], [1e308, -1e308, 3.0], [1.0, math.nextafter(1.0, 2.0), 1e-300, 5.0, None]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(2)
    assert perf.middle(df, "x") == df.agg(F.percentile("x", F.lit(0.5))).first()[0]


def test_median_of_many(spark, monkeypatch):
    monkeypatch.setattr(perf, "BUCKETS", 3)
    rng = random.Random(4)
    for n in (100, 101):
        df = spark.createDataFrame([(rng.choice([rng.random(), 0.25, rng.random() * 1e9]),) for _ in range(n)], "x double")
        assert perf.middle(df, "x") == pytest.approx(df.agg(F.percentile("x", F.lit(0.5))).first()[0], rel=1e-12)


def test_places_of_a_report(spark):
    rng = random.Random(8)
    base = spark.createDataFrame([("c", f"s{i}", rng.choice([1.0, 2.0, 3.0])) for i in range(60)], "category string, sample string, perf_us double").repartition(4)
    report = perf.compare(base, base.withColumn("perf_us", F.lit(2.0)))
    for by in ("speedup", "abs", "sample"):
        want = [r["sample"] for r in perf.sort_report(report, by).collect()]
        assert [(r["place"], r["sample"]) for r in perf.placed_report(report, by).orderBy("place").collect()] == list(enumerate(want, 1))


def random_rows(seed, m=60, columns=25):
    rng = random.Random(seed)
    return {r: frozenset(rng.sample(range(columns), rng.randrange(1, 6))) for r in range(m) if rng.random() < 0.9}


def like(a, b):
    return len(a & b) / len(a | b)


def frame(spark, sets):
    return spark.createDataFrame([(r, c, 1.0) for r, cols in sets.items() for c in cols], COO)


def test_pairs_of_hot_columns(spark, monkeypatch):
    sets = random_rows(1)
    want = sorted((i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and like(sets[i], sets[j]) >= 0.2)
    for limit in (reorder.HOT_COLUMN, 3):
        monkeypatch.setattr(reorder, "HOT_COLUMN", limit)
        assert rows(reorder.jaccard_pairs(frame(spark, sets)), "i", "j", "inter") == want
    found = set(rows(reorder.lsh_jaccard_pairs(frame(spark, sets)), "i", "j", "inter"))
    assert found <= set(want) and len(found) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [64, 2])
def test_forest_order(spark, n):
    """Against Kruskal's forest over the same pairs, walked by hand."""
    sets, m = random_rows(2), 63
    near = {(min(i, j), max(i, j), w) for i in sets for w, j in sorted(((like(sets[i], sets[j]), j) for j in sets if j != i and like(sets[i], sets[j]) >= 0.2), reverse=True)[:n]}
    trees = {}
    for root, _, row in plain_walk(kruskal(near)[0]):
        trees.setdefault(root, []).append(row)
    inside = {x for t in trees.values() for x in t}
    order = [x for root in range(m) if root in trees or root not in inside for x in trees.get(root, [root])]
    got = reorder.mkst_order(frame(spark, sets), m, n).orderBy("new_row").collect()
    assert [tuple(r) for r in got] == list(enumerate(order))


def cluster_by_hand(sets, cap, later):
    todo = [(like(sets[i], sets[j]), i, j, (j, i) if later else (i, j)) for i in sets for j in sets if i < j and like(sets[i], sets[j]) >= 0.2]
    parts = [{"lead": x, "rows": {x}} for x in sets]
    of = lambda x: next(p for p in parts if x in p["rows"])
    while todo:
        todo.sort(key=lambda e: (-e[0], e[1], e[2]))
        _, i, j, (a, b) = todo.pop(0)
        p, q = of(a), of(b)
        if p is q or len(p["rows"]) >= cap or len(q["rows"]) >= cap:
            continue
        if {p["lead"], q["lead"]} == {i, j}:
            up, down = (q, p) if len(p["rows"]) < len(q["rows"]) else (p, q)
            up["rows"] |= down["rows"]
            parts.remove(down)
        else:
            x, y = p["lead"], q["lead"]
            if not any({e[1], e[2]} == {x, y} for e in todo):
                todo.append((like(sets[x], sets[y]), min(x, y), max(x, y), (x, y)))
    return sorted(sorted(p["rows"]) for p in parts)


def clusters_in_turn(spark, sets, cap, later):
    """The clusters of one walk through the pairs in order, by their least rows."""
    pairs = [(i, j, like(sets[i], sets[j])) for i in sets for j in sets if i < j and like(sets[i], sets[j]) >= 0.2]
    turns = spark.createDataFrame(pairs, "i long, j long, sim double").selectExpr("i", "j", "sim", "xxhash64(i, j)").collect()
    parts = {x: [x] for x in sets}
    for x, up in plain_merge([tuple(r) for r in turns], cap, later).items():
        if x != up:
            parts[up] += parts.pop(x)
    return sorted(sorted(p) for p in parts.values())


@pytest.mark.parametrize("caps", [(16, 128), (3, 2)])
def test_cluster_order(spark, caps):
    sets, m = random_rows(4), 63
    inner = clusters_in_turn(spark, sets, caps[0], True)
    unions = {p[0]: frozenset().union(*(sets[r] for r in p)) for p in inner}
    rows_of = {p[0]: p for p in inner}
    outer = clusters_in_turn(spark, unions, caps[1], False) + [[r] for r in range(m) if r not in sets]
    order = [r for part in sorted(outer) for c in part for r in rows_of.get(c, [c])]
    got = reorder.dtc_order(frame(spark, sets), m, cap=caps[0], outer_cap=caps[1]).orderBy("new_row").collect()
    assert [tuple(r) for r in got] == list(enumerate(order))


@pytest.mark.parametrize("seed", range(6))
def test_clusters_are_as_close_as_those_of_a_queue(spark, seed):
    """Against merging that goes on with pairs of leading rows that are hardly alike."""
    sets = random_rows(seed)
    inside = lambda parts: [like(sets[i], sets[j]) for p in parts for i in p for j in p if i < j]
    mine, queue = inside(clusters_in_turn(spark, sets, 16, True)), inside(cluster_by_hand(sets, 16, True))
    assert not queue or sum(mine) / len(mine) >= sum(queue) / len(queue)


def test_streamed_product(spark, tmp_path):
    """Entries that arrive in two files, one coordinate in both, give the product of all of them."""
    parts = [[(0, 1, 2.0), (3, 2, 1.0)], [(0, 1, 5.0), (4, 0, -1.0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, COO).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COO).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = spmm.spmm_formula(stream, 3).writeStream.format("memory").queryName("running").outputMode("complete")
    running.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    want = rows(spmm.spmm_formula(spark.createDataFrame(parts[0] + parts[1], COO), 3), "row", "n", "val")
    assert rows(spark.table("running"), "row", "n", "val") == want


def test_matrix_kept_current(spark, tmp_path):
    """Over two runs: later entries replace earlier ones, however they arrive; only touched rows are made anew."""
    schema = "row long, col long, val double, seq long"
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def arrive(*entries):
        spark.createDataFrame(entries, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        incremental.follow(stream, log, state)
        return rows(incremental.current(spark, log), "row", "col", "val")

    arrive((0, 1, 2.0, 5), (0, 1, 9.0, 4), (3, 2, 1.0, 1), (3, 2, 1.0, 1), (None, 1, 1.0, 1), (1, 1, 1.0, None))
    first = run()
    assert first == [(0, 1, 2.0), (3, 2, 1.0)] == run()
    seen = spark.read.parquet(log).agg(F.max("batch")).first()[0]
    # One newer, one late, one of the same seq with a greater value, one new place with a stored 0.
    arrive((0, 1, 7.0, 6))
    arrive((0, 1, -1.0, 3), (3, 2, 4.0, 1), (8, 0, 0.0, 2))
    assert run() == [(0, 1, 7.0), (3, 2, 4.0), (8, 0, 0.0)]
    arrive((8, 2, 3.0, 1))
    mark = spark.read.parquet(log).agg(F.max("batch")).first()[0]
    assert mark > seen
    standing = run()
    times = lambda a: spmm.spmm_formula(a, 3)
    whole = rows(times(incremental.current(spark, log)), "row", "n", "val")
    assert rows(incremental.refreshed(spark, log, mark, times), "row", "n", "val") == [r for r in whole if r[0] == 8]
    assert rows(incremental.refreshed(spark, log, -1, times), "row", "n", "val") == whole
    assert standing == [(0, 1, 7.0), (3, 2, 4.0), (8, 0, 0.0), (8, 2, 3.0)]


def test_sources(spark, tmp_path):
    d = tmp_path / "HB"
    d.mkdir()
    (d / "tiny.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 20 4\n1 1 2.0\n1 18 3.0\n3 18 -1.5\n2 5 4\n")
    (d / "pat.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n\n1 1\n")
    entries, meta = matrix_market.read_mtx(spark, str(tmp_path))
    assert rows(entries.filter("matrix = 'tiny'"), "row", "col", "val") == sorted(F1)
    assert rows(entries.filter("matrix = 'pat'"), "row", "col", "val") == [(0, 0, 1.0)]
    assert rows(meta, "category", "matrix", "m", "k", "nnz") == [("HB", "pat", 2, 2, 1), ("HB", "tiny", 3, 20, 4)]
    (d / "bad.mtx").write_text("2 2 1\n1 1 1 1\n")
    with pytest.raises(Exception, match="2 or 3 columns"):
        matrix_market.read_mtx(spark, str(d / "bad.mtx"))[0].collect()
    (d / "few.mtx").write_text("2 2 3\n1 1 1\n")
    for table in matrix_market.read_mtx(spark, str(d / "few.mtx")):
        with pytest.raises(Exception, match="differ from the header"):
            table.collect()
    assert matrix_market.read_mtx(spark, str(d / "few.mtx"), check=False)[0].count() == 1
    other = tmp_path / "more" / "HB"
    other.mkdir(parents=True)
    (other / "tiny.mtx").write_text("%%MatrixMarket matrix coordinate real Skew-Symmetric\n% note\n3 3 2\n2 1 4.0\n3 1 -1\n")
    (other / "even.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n2 2 2\n1 1 3\n2 1 4\n")
    skew, both = matrix_market.read_mtx(spark, str(tmp_path / "more"), expand_symmetry=True)
    assert rows(skew.filter("matrix = 'tiny'"), "row", "col", "val") == [(0, 1, -4.0), (0, 2, 1.0), (1, 0, 4.0), (2, 0, -1.0)]
    assert rows(skew.filter("matrix = 'even'"), "row", "col", "val") == [(0, 0, 3.0), (0, 1, 4.0), (1, 0, 4.0)]
    assert rows(both, "matrix", "symmetry", "stored") == [("even", "symmetric", 2), ("tiny", "skew-symmetric", 2)]
    matrix_market.write_mtx(spark.createDataFrame(F1, COO).repartition(3), str(tmp_path / "w" / "HB" / "out.mtx"), 3, 20)
    again, meta = matrix_market.read_mtx(spark, str(tmp_path / "w"))
    assert rows(again, "category", "matrix", "row", "col", "val") == [("HB", "out", *e) for e in sorted(F1)]
    assert rows(meta, "m", "k", "nnz", "stored") == [(3, 20, 4, 4)]
    np.array([2, 0, 1], dtype=np.int32).tofile(tmp_path / "r.bin")
    assert rows(binary.read_reorder_map(spark, str(tmp_path / "r.bin")), "new_row", "old_row") == [(0, 2), (1, 0), (2, 1)]
    place = str(tmp_path / "vals.bin")
    assert binary.write_array(spark.range(0, 1000, 1, 7).select(F.col("id").alias("idx"), (F.col("id") / 8).alias("value")), place, "float16") == 1000
    assert rows(binary.read_array(spark, place, "float16"), "idx", "value") == [(i, i / 8) for i in range(1000)]
    for size in (1, 7, 64, 1 << 30):
        assert rows(binary.read_array(spark, place, "float16", size), "idx", "value") == [(i, i / 8) for i in range(1000)]
    (tmp_path / "none.dat").write_bytes(b"")
    with pytest.raises(Exception, match="not an array"):
        binary.read_array(spark, str(tmp_path / "none.dat")).collect()
    log = tmp_path / "perf.txt"
    log.write_text(
        "Format: x\n===\nHB | a | 16 | 16 | 128 | 5 | 1 | 1 | 5.0 | 12.5\nHB | a | 16 | 16 | 128 | 5 | 1 | 1 | 5.0 | 11.5\nshort | row\n"
        "[2020-01-01 00:00:00] | Category: HB | Sample: a | Dims(16, 16, 128, 5) | Perf: 9.5 | Verify: SUCCESS\n"
    )
    lines = logs.text_lines(spark, str(log))
    good, bad = logs.perf_log(lines)
    assert good.count() == 2 and bad.count() == 2
    assert rows(logs.perf_log_strict(lines), "sample", "perf_us") == [("a", 11.5)]
    assert rows(logs.reorder_log(lines), "sample", "nnz", "perf", "verify") == [("a", 5, 9.5, "SUCCESS")]
    t = tmp_path / "t.txt"
    t.write_text("s1\nlaunch:\nRun 1: 3.5 ms\nlaunch:\nRun 2: 4.5 ms\n")
    assert rows(logs.timing_log(logs.text_lines(spark, str(t))), "timer", "run", "ms") == [("launch", 1, 3.5), ("launch", 2, 4.5)]
    assert logs.timing_log(logs.text_lines(spark, str(t)), ["other"]).count() == 0
    out, built = str(tmp_path / "out"), []
    for n in (3, 5):
        got = sinks.reuse_or_build(spark, out, lambda n=n: built.append(n) or spark.range(n))
        assert got.count() == 3
    assert built == [3]
    spark.range(4).write.parquet(str(tmp_path / "input"))
    use = lambda params: sinks.reuse_or_build(spark, out, lambda: built.append(params) or spark.read.parquet(str(tmp_path / "input")), [str(tmp_path / "input")], params).count()
    assert [use({"b": 1}), use({"b": 1}), use({"b": 2})] == [4, 4, 4] and built == [3, {"b": 1}, {"b": 2}]
    spark.range(2).write.mode("append").parquet(str(tmp_path / "input"))
    assert [use({"b": 1}), use({"b": 1})] == [6, 6] and built == [3, {"b": 1}, {"b": 2}, {"b": 1}]
    # A table without its mark was not finished.
    place = f"{out}/{sinks.fingerprint(spark, [str(tmp_path / 'input')], {'b': 1})}"
    spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{place}.done")
    assert use({"b": 1}) == 6 and len(built) == 5
    sinks.write_text(good.drop("seq", "file"), str(tmp_path / "csv"), header=True)
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True), "category", "perf_us") == [("HB", "11.5"), ("HB", "12.5")]
    sinks.append_log(good, str(tmp_path / "again"))
    sinks.append_log(good, str(tmp_path / "again"))
    assert logs.perf_log(logs.text_lines(spark, str(tmp_path / "again")))[0].count() == 4
    assert rows(logs.delimited(spark, str(tmp_path / "again")), "sample", "perf_us") == [("a", 11.5)] * 2 + [("a", 12.5)] * 2
    sinks.write_metadata(spark.createDataFrame([(3, "x=y")], "m int, name string"), str(tmp_path / "meta"))
    assert rows(sinks.read_metadata(spark, str(tmp_path / "meta")), "key", "value") == [("M", "3"), ("NAME", "x=y")]
    times = spark.createDataFrame([("s:1", "run", 1, 2.5), ("s:1", "load", 1, 0.25), ("s2", "run", 1, 4.0)], "sample string, timer string, run int, ms double")
    sinks.append_timings(times, str(tmp_path / "times"))
    assert rows(logs.timing_log(logs.text_lines(spark, str(tmp_path / "times"))), "sample", "timer", "run", "ms") == rows(times, "sample", "timer", "run", "ms")
    (tmp_path / "op.csv").write_text('op,kind,time\nx,"a,b",12.5 us\ny,c,n/a\n')
    assert rows(logs.profiler_csv(spark, str(tmp_path / "op.csv")).filter("perf_us is not null"), "perf_us") == [(12.5,)]
    assert rows(sinks.report_lines(spark.createDataFrame([("a", 5)], "x string, y int"), {"x": 4, "y": 3}), "line") == [("a    5  ",)]


def test_long_timing_log(spark, tmp_path, monkeypatch):
    """A timer that closes one split and its run that opens the next belong together."""
    lines = []
    for i in range(400):
        lines += [f"Sample: s{i}", "  launch:", f"    Run 1: {i}.5 ms"]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = logs.timing_log(logs.text_lines(spark, str(tmp_path / "t.txt")))
        assert rows(got, "sample", "timer", "ms") == sorted((f"s{i}", "launch", i + 0.5) for i in range(400))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("tile_bytes, sums_bytes", [(1, 1), (5 * 8 * 7, 5 * 8 * 11), (spmm.TILE_BYTES, spmm.SUMS_BYTES)])
def test_tiled_product(spark, tile_bytes, sums_bytes):
    rng = random.Random(3)
    # A third of the entries in one column; repeated places; a row with a value in every column; ids above 2^53; columns without a row of B.
    entries = [(rng.randrange(90), 4 if i % 3 == 0 else rng.randrange(60), float(rng.randrange(-3, 4))) for i in range(600)]
    entries += [(91, c, 1.0) for c in range(60)] + [(2**60 + 1, 7, 2.0), (2**60 + 2, 7, 3.0), (92, 400, 1.0), (93, 0, 0.0)]
    a = spark.createDataFrame([*entries, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], COO)
    b = spmm.dense_b_rows(spark, 53, 5)
    got = {r["row"]: r["c"] for r in spmm.spmm_tiled(a, b, 5, tile_bytes, sums_bytes).collect()}
    want = {}
    for r, c, v in entries:
        if c < 53:
            want[r] = [x + v * (1 + (31 * c + 17 * n) % 10) for n, x in enumerate(want.get(r, [0.0] * 5))]
    assert got == want
    assert spmm.spmm_tiled(a.limit(0), b, 5).count() == spmm.spmm_tiled(a, b.limit(0), 5).count() == 0


def test_sums_of_a_row_lie_side_by_side(spark):
    """Widths beside and beyond a lane; ragged rows and nulls as in the plain sums; the exchange carries no row for each cell."""
    coo = spark.createDataFrame([(r, c, float(r * c % 7 + 1)) for r in range(9) for c in range(5) if (r + c) % 3], "row long, col long, val double")
    cells = {(r["row"], r["col"]): r["val"] for r in coo.collect()}
    for n in (1, 8, 19):
        got = {(r["row"], r["n"]): r["val"] for r in spmm.spmm_formula(coo, n).collect()}
        assert got == {(i, j): sum(v * (1 + (31 * c + 17 * j) % 10) for (r, c), v in cells.items() if r == i) for i, _ in cells for j in range(n)}
        assert got == {(r["row"], r["n"]): r["val"] for r in spmm.spmm_rows(coo, spmm.dense_b_rows(spark, 5, n)).collect()}
    ragged = spark.createDataFrame([(0, [2.0, None]), (1, [3.0] * 10), (2, [])], "k long, b array<double>")
    ones = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)], "row long, col long, val double")
    got = sorted(tuple(r) for r in spmm.spmm_rows(ones, ragged).collect())
    assert got == [(0, 0, 2.0), (0, 1, None), *[(1, j, 3.0) for j in range(10)]]
    plan = spmm.spmm_formula(coo, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Aggregate")
