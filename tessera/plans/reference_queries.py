"""The registered matrix and log queries with their SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import round_f16
from tessera.functions.prefix import running_start, running_sum_in_order
from tessera.functions.store import fresh_path, stored
from tessera.operators import coo as C
from tessera.operators import layout, partition, perf, reorder, spmm, verify
from tessera.sources import binary, logs, matrix_market, sinks
from tessera.streaming import incremental

N = 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_parts(spark: SparkSession, d: str) -> DataFrame:
    """A: order x part, summed quantities."""
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    return C.dedup(raw)


def users_events(spark: SparkSession, d: str) -> DataFrame:
    """A: user x event type, counts."""
    events = table(spark, d, "events")
    per = events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("val"))
    kinds = per.select("event_type").distinct()
    code = kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("col"))
    return per.join(code, "event_type").select(F.col("user_id").alias("row"), "col", "val")


def part_count(spark: SparkSession, d: str) -> int:
    """One more than the largest part key, from the parquet column alone."""
    return (table(spark, d, "part").agg(F.max("p_partkey")).first()[0] or 0) + 1


def order_count(spark: SparkSession, d: str) -> int:
    return (table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0) + 1


def spmm_orders_parts(spark, d):
    return spmm.spmm_rows(orders_parts(spark, d), spmm.dense_b_rows(spark, part_count(spark, d), N))


def spmm_users_events(spark, d):
    return spmm.spmm_formula(users_events(spark, d), N)


def spmm_dense_grid(spark, d):
    return spmm.dense_grid(spmm.spmm_formula(orders_parts(spark, d), N), order_count(spark, d), N)


def spmm_f16(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), (F.col("l_quantity") / 10).alias("val"))
    half = C.dedup(raw.withColumn("val", F.rint(round_f16(F.col("val")) * 2**20)))
    return spmm.spmm_formula(half, N)


def coo_dedup_sum(spark, d):
    return orders_parts(spark, d)


def coo_dedup_last(spark, d):
    t = table(spark, d, "lineitem")
    raw = t.withColumns({"row": F.col("l_orderkey"), "col": F.col("l_partkey"), "val": F.col("l_quantity")})
    return C.dedup(raw, "last", ["l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity"])


def csr_row_ptr(spark, d):
    return layout.csr_row_ptr(orders_parts(spark, d))


def bcsr_blocks(spark, d):
    return layout.bcsr_blocks(orders_parts(spark, d))


def condensed_positions(spark, d):
    return layout.condensed_positions(orders_parts(spark, d))


def condensed_windows(spark, d):
    return layout.condensed_window_blocks(orders_parts(spark, d))


def condensed_blocks(spark, d):
    return layout.condensed_blocks(orders_parts(spark, d), then=layout.STORED_CELLS)


def bcsr_values(spark, d):
    """Each block's sum and its sum weighted by place, from the dense values."""
    return layout.bcsr_values(orders_parts(spark, d), then=layout.BLOCK_SUMS)


def csr_round_trip(spark, d):
    return layout.from_csr(layout.to_csr(orders_parts(spark, d)))


def bounds_filter(spark, d):
    return C.within_bounds(orders_parts(spark, d), order_count(spark, d) // 2, part_count(spark, d) // 2)


def bounds_dropped(spark, d):
    return C.count_out_of_bounds(orders_parts(spark, d), order_count(spark, d) // 2, part_count(spark, d) // 2)


def skew_expanded(spark, d):
    return C.expand_symmetry(orders_parts(spark, d).filter("row < col"), -1.0)


def customer_order(spark, d) -> DataFrame:
    """The orders by customer, as a new order of the matrix's rows."""
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(1).alias("one"))
    return running_sum_in_order(t, [], [F.col("o_custkey"), F.col("o_orderkey")], "one", "new_row").select("new_row", F.col("o_orderkey").alias("old_row"))


def padded_order(spark, d):
    m = order_count(spark, d)
    return C.pad_rows(customer_order(spark, d), m, (m + 15) // 16 * 16)


def permuted_rows(spark, d):
    return C.permute_rows(orders_parts(spark, d), customer_order(spark, d))


def half_matrix(spark, d, symmetry):
    """The parts and suppliers, as a matrix file written and read again."""
    path = fresh_path(spark)
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
    if symmetry != "general":
        t = t.filter("row >= col")
    n = part_count(spark, d)
    matrix_market.write_mtx(t, f"{path}/first/lines.mtx", n, n, symmetry)
    return matrix_market.read_mtx(spark, path, expand_symmetry=symmetry != "general")


def mtx_entries(spark, d):
    return half_matrix(spark, d, "general")[0].drop("file")


def mtx_meta(spark, d):
    return half_matrix(spark, d, "general")[1].drop("file")


def mtx_skew_entries(spark, d):
    return half_matrix(spark, d, "skew-symmetric")[0].select("row", "col", "val")


def window_array(spark, d):
    """The windows' running block numbers as a raw array, read again."""
    starts = running_start(all_windows(spark, d), "rw", "nblocks", "start")
    path = f"{fresh_path(spark)}/rw_ptr.bin"
    binary.write_array(starts.select(F.col("rw").alias("idx"), F.col("start").alias("value")), path)
    return binary.read_array(spark, path).select("idx", "value")


def reorder_map(spark, d):
    path = f"{fresh_path(spark)}/reorder_ref.bin"
    binary.write_array(customer_order(spark, d).select(F.col("new_row").alias("idx"), F.col("old_row").alias("value")), path)
    return binary.read_reorder_map(spark, path)


def core_table(spark, d):
    path = fresh_path(spark)
    sinks.write_table(core_split_24(spark, d), path)
    return spark.read.parquet(path)


def reused_table(spark, d):
    """Built once for its input; the second call finds it and builds nothing, and another parameter builds another."""
    path = fresh_path(spark)
    build = lambda block: sinks.reuse_or_build(spark, path, lambda: layout.bcsr_blocks(orders_parts(spark, d), block), [f"{d}/lineitem.parquet"], {"block": block})
    for block in (16, 8):
        build(block)
    again = lambda block: sinks.reuse_or_build(spark, path, lambda: spark.range(0), [f"{d}/lineitem.parquet"], {"block": block}).withColumn("block", F.lit(block))
    return again(16).unionByName(again(8))


def gather_text(spark, d):
    """Gather lists as text, read again."""
    path = fresh_path(spark)
    lists = layout.condensed_blocks(orders_parts(spark, d)).select("rw", "blk", "cols")
    sinks.write_text(lists, path)
    return spark.read.csv(path, schema="rw long, blk long, cols string")


def block_metadata(spark, d):
    path = fresh_path(spark)
    sinks.write_metadata(layout.fill_rates(orders_parts(spark, d)).select("nnz", "blocks", "condensed_blocks"), path)
    return sinks.read_metadata(spark, path)


def part_log(spark, d) -> DataFrame:
    """A performance log made of the parts."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("category"), F.concat(F.lit("p"), key).alias("sample"), key.alias("m"), size.alias("k"), F.lit(128).cast("long").alias("n"), (key * 2).alias("nnz"),
        (key % 7).alias("window_num"), size.alias("block_num"), (size / 64).alias("fill_rate"), F.col("p_retailprice").alias("perf_us"),
    )


def log_rows(spark, d):
    path = fresh_path(spark)
    sinks.append_log(part_log(spark, d), path)
    return logs.perf_log(logs.text_lines(spark, path))[0].select(*logs.PERF_FIELDS)


def log_counts(spark, d):
    """Rows read and rejected of a log with headings, short lines and times that are no number."""
    path = fresh_path(spark)
    rows = part_log(spark, d).select(F.concat_ws(" | ", *logs.PERF_FIELDS[:9], F.when(F.col("m") % 10 == 0, "n/a").otherwise(F.col("perf_us").cast("string"))).alias("line"))
    odd = spark.createDataFrame([("Format: a | b",), ("=====",), ("short | row",), ("",)], "line string")
    rows.unionByName(odd).select(F.col("line").alias("value")).write.text(path)
    good, bad = logs.perf_log(logs.text_lines(spark, path))
    return good.agg(F.count("*").alias("read")).join(bad.agg(F.count("*").alias("rejected")))


def log_last_rows(spark, d):
    """Each sample twice, the second time slower: the strict reading keeps the last."""
    path = fresh_path(spark)
    line = lambda add: F.concat_ws(" | ", *logs.PERF_FIELDS[:9], (F.col("perf_us") + add).cast("string"))
    twice = part_log(spark, d).select(F.posexplode(F.array(line(0), line(1))).alias("again", "line"), "m")
    sinks.write_lines(twice.select(F.struct("again", "m").alias("place"), "line"), path)
    return logs.perf_log_strict(logs.text_lines(spark, path))


def reorder_log_rows(spark, d):
    path = fresh_path(spark)
    key = F.col("o_orderkey")
    t = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("category"), F.concat(F.lit("o"), key).alias("sample"), key.alias("m"), F.col("o_custkey").alias("k"), F.lit(128).alias("n"),
        (key * 3).alias("nnz"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("perf"), F.when(key % 2 == 0, "SUCCESS").otherwise("SKIPPED (no golden file)").alias("verify"),
    )
    sinks.append_reorder_log(t, path)
    return logs.reorder_log(logs.text_lines(spark, path)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def timing_log_rows(spark, d):
    path = fresh_path(spark)
    t = table(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("sample"), F.col("event_type").alias("timer")).agg(F.sum(F.round(F.col("value") * 1000)).alias("ms"))
    sinks.append_timings(t.withColumn("run", F.lit(1)), path)
    return logs.timing_log(logs.text_lines(spark, path)).drop("file")


def profiler_times(spark, d):
    path = fresh_path(spark)
    t = table(spark, d, "part").select(F.col("p_name").alias("Op Name"), F.col("p_type").alias("Op Type"), F.concat("p_retailprice", F.lit(" us")).alias("Task Duration"))
    t.write.csv(path, header=True)
    return logs.profiler_csv(spark, path)


def delimited_rows(spark, d):
    path = fresh_path(spark)
    sinks.append_log(part_log(spark, d), path)
    return logs.delimited(spark, path)


def valid_times(spark, d):
    """Samples and mean with failed profiles left out, and with them, as the two modes count."""
    t = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("l_quantity")).alias("perf_us"))
    mean = lambda zeros: perf.valid(t, zeros).agg(F.lit(zeros).alias("zeros"), F.count("*").alias("samples"), F.round(F.avg("perf_us"), 6).alias("mean"))
    return mean(False).unionByName(mean(True))


def samples_in_order(spark, d):
    return perf.ordered(part_log(spark, d)).select("category", "place", "sample")


def category_lines(spark, d):
    return perf.category_report(brand_perf(spark, d)).select("line")


def compare_lines(spark, d):
    base, opt = sides(spark, d)
    return perf.compare_report(perf.compare(base, opt).withColumns({"m": F.lit(1).cast("long"), "block_num": F.lit(2).cast("long")}), base, opt).select("line")


def compare_places(spark, d):
    """The place of each sample in the report by speedup and in that by gain."""
    report = perf.compare(*sides(spark, d))
    place = lambda by: perf.placed_report(report, by).select(F.lit(by).alias("sort"), "place", "category", "sample")
    return place("speedup").unionByName(place("abs"))


def dumped_grid(spark, d):
    return verify.dump_grid(spmm_orders_parts(spark, d), 4)


def gather_list(spark, d):
    return layout.gather_list(orders_parts(spark, d)).withColumn("slot", F.col("slot").cast("long"))


def fill_rates(spark, d):
    return layout.fill_rates(orders_parts(spark, d))


def all_windows(spark, d):
    """(rw, nblocks) with the empty windows."""
    n = (order_count(spark, d) + 15) // 16
    have = layout.condensed_window_blocks(orders_parts(spark, d)).select("rw", "nblocks")
    return spark.range(n).withColumnRenamed("id", "rw").join(have, "rw", "left").select("rw", F.coalesce("nblocks", F.lit(0)).alias("nblocks"))


def core_split_24(spark, d):
    return partition.core_split(all_windows(spark, d), 24)


def jaccard_pairs(spark, d):
    return reorder.jaccard_pairs(orders_parts(spark, d)).select("i", "j", "inter", "union_size")


def knn_topn(spark, d):
    return reorder.knn_topn(reorder.jaccard_pairs(orders_parts(spark, d)), 64).select("i", "j")


def lsh_pairs(spark, d):
    return reorder.lsh_jaccard_pairs(orders_parts(spark, d)).select("i", "j", "inter", "union_size")


def lsh_recall(spark, d):
    """How the banded search does against the exact one, by threshold: pairs it made up, and whether it found nine of ten."""
    # What no threshold changes is made once; each threshold's counts stand before the next one begins.
    cells = stored(orders_parts(spark, d).select("row", "col"))
    sets, sketch = reorder.column_sets(cells), reorder.sketches(cells)
    exact, found = stored(reorder.jaccard_pairs(cells, sets=sets).select("i", "j", "sim")), None
    for threshold in (0.2, 0.35, 0.5, 0.8):
        near = reorder.sketched_pairs(sketch, cells, threshold, sets=sets).select("i", "j", F.lit(1).alias("hit"))
        both = exact.filter(F.col("sim") >= threshold).select("i", "j", F.lit(1).alias("true")).join(near, ["i", "j"], "full_outer")
        counted = both.agg(F.count("true").alias("pairs"), F.count_if(F.col("true").isNull()).alias("made_up"), F.count_if(F.col("true").isNotNull() & F.col("hit").isNotNull()).alias("hits"))
        one = stored(counted.select(F.lit(threshold).alias("threshold"), "pairs", "made_up", (F.col("hits") >= 0.9 * F.col("pairs")).alias("recalled")))
        found = one if found is None else found.unionByName(one)
    return found


def mkst_forest(spark, d):
    """How many edges of each similarity the maximum spanning forest has: the same for all such forests."""
    forest, _ = reorder.mkst_forest(orders_parts(spark, d))
    return forest.groupBy(F.round("w", 9).alias("sim")).agg(F.count("*").alias("edges"))


def order_laws(spark, d):
    """What makes an order of rows: as many as there are, none twice, places gapless from 0."""
    found = None
    for name, order in (("mkst", mkst_order(spark, d)), ("dtc", dtc_order(spark, d))):
        counts = [F.count("*").alias("rows"), F.countDistinct("old_row").alias("old"), F.countDistinct("new_row").alias("new"), F.min("new_row").alias("first"), F.max("new_row").alias("last")]
        one = order.agg(*counts).withColumn("name", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def mkst_order(spark, d):
    return reorder.mkst_order(orders_parts(spark, d), order_count(spark, d))


def dtc_order(spark, d):
    return reorder.dtc_order(orders_parts(spark, d), order_count(spark, d))


def spmm_reordered_restored(spark, d):
    order = stored(mkst_order(spark, d))
    c = spmm.spmm_formula(C.permute_rows(orders_parts(spark, d), order), N)
    return C.restore_rows(c, order)


def spmm_blocked(spark, d):
    k = part_count(spark, d)
    return spmm.spmm_blocked(orders_parts(spark, d), spmm.dense_b_rows(spark, k, N), k, N)


def spmm_rowvec(spark, d):
    k = part_count(spark, d)
    wide = spmm.spmm_rowvec(orders_parts(spark, d), spmm.dense_b_rows(spark, k, N), k, N)
    return wide.select("row", F.posexplode("c").alias("n", "val"))


def spmm_wide_128(spark, d):
    """N = 128, a checksum for each row of C."""
    k = part_count(spark, d)
    wide = spmm.spmm_rowvec(orders_parts(spark, d), spmm.dense_b_rows(spark, k, 128), k, 128)
    return wide.select("row", F.aggregate("c", F.lit(0.0), lambda s, x: s + x).alias("row_sum"), F.array_max("c").alias("row_max"))


def spmm_tiled_128(spark, d):
    """The same product and checksums by tiles of B, whatever its size."""
    tiled = spmm.spmm_tiled(orders_parts(spark, d), spmm.dense_b_rows(spark, part_count(spark, d), 128), 128)
    return tiled.select("row", F.aggregate("c", F.lit(0.0), lambda s, x: s + x).alias("row_sum"), F.array_max("c").alias("row_max"))


def streamed_product(spark, d):
    """The product of a matrix kept current from a stream: of the lines at a place, the last one counts."""
    lines = spark.readStream.schema(table(spark, d, "lineitem").schema).parquet(incremental.as_glob(f"{d}/lineitem.parquet"))
    entries = lines.select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"), F.col("l_linenumber").alias("seq"))
    path = fresh_path(spark)
    incremental.follow(entries, f"{path}/log", f"{path}/checkpoint")
    return spmm.spmm_formula(incremental.current(spark, f"{path}/log"), N)


def verify_close(spark, d):
    return verify.verify(spmm_blocked(spark, d), spmm_orders_parts(spark, d))


def verify_mismatches(spark, d):
    golden = stored(spmm_orders_parts(spark, d))
    off = golden.withColumn("val", F.col("val") + F.when(F.col("row") % 100 == 0, 1.0).when(F.col("row") % 100 == 1, -1.0).otherwise(0.0))
    return verify.mismatches(off, golden).select("row", "n", "o", "g", F.round("rdiff", 9).alias("rdiff"))


def brand_perf(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("category"), F.col("l_quantity").alias("perf_us"))


def perf_by_group(spark, d):
    return perf.by_group(brand_perf(spark, d)).select("category", "total", "samples", F.round("mean", 6).alias("mean"), F.round("pct", 6).alias("pct"))


def perf_grand_total(spark, d):
    return perf.with_grand_total(brand_perf(spark, d)).select("category", "total", "samples", F.round("mean", 6).alias("mean"))


def sides(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_partkey").cast("string").alias("sample"), "l_linestatus", "l_quantity")
    per = lambda s: t.filter(F.col("l_linestatus") == s).groupBy("category", "sample").agg(F.sum("l_quantity").alias("perf_us"))
    return per("O"), per("F")


def perf_compare(spark, d):
    return perf.compare(*sides(spark, d)).withColumn("speedup", F.round("speedup", 9))


def perf_summary(spark, d):
    s = perf.summary(perf.compare(*sides(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes])


def perf_only_one_side(spark, d):
    return perf.only_one_side(*sides(spark, d))


def mean_time_by_timer(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample"), F.col("event_type").alias("timer"), F.lit(1).alias("run"), F.round(F.col("value") * 1000).alias("ms"))
    return perf.mean_time(t).withColumn("mean_ms", F.round("mean_ms", 6))


def spmm_embeddings(spark, d):
    """A: label x vector ones; B: the embeddings in thousandths, so sums are exact."""
    e = table(spark, d, "embeddings")
    a = e.select(F.col("label").cast("long").alias("row"), F.col("vec_id").alias("col"), F.lit(1.0).alias("val"))
    b = e.select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("b"))
    return spmm.spmm_rows(a, b)


A = "a as (select l_orderkey as row, l_partkey as col, sum(l_quantity) as val from lineitem group by 1, 2)"
B_VAL = "(1 + (31 * col + 17 * n) % 10)"
NS = f"(select unnest(range({N})) as n)"
SPMM = f"select row, cast(n as integer) as n, cast(sum(val * {B_VAL}) as double) as val from a, {NS} group by 1, 2"
COND = "c as (select distinct row // 16 as rw, col from a), p as (select rw, col, row_number() over (partition by rw order by col) - 1 as pos from c)"
WIN = "w as (select rw, count(*) as ncols, (count(*) + 15) // 16 as nblocks from c group by 1)"
PAIRS = """cells as (select distinct row, col from a), s as (select row, count(*) as sz from cells group by 1),
it as (select x.row as i, y.row as j, count(*) as inter from cells x join cells y on x.col = y.col and x.row < y.row group by 1, 2),
pr as (select i, j, inter, si.sz + sj.sz - inter as union_size from it join s si on si.row = i join s sj on sj.row = j where inter * 5 >= si.sz + sj.sz - inter)"""
SIDES = """t as (select l_returnflag as category, cast(l_partkey as varchar) as sample, l_linestatus as st, sum(l_quantity) as q from lineitem group by 1, 2, 3),
b as (select category, sample, q from t where st = 'O'), o as (select category, sample, q from t where st = 'F')"""
CMP = """cm as (select category, sample, b.q as base, o.q as opt, b.q - o.q as diff, b.q / o.q as speedup,
case when b.q / o.q > 1.005 then 'improved' when b.q / o.q < 0.995 then 'regressed' else 'unchanged' end as verdict from b join o using (category, sample))"""
BRAND = "v as (select p_brand as category, l_quantity as q from lineitem join part on l_partkey = p_partkey)"
LOG = """select p_brand as category, 'p' || p_partkey as sample, p_partkey as m, cast(p_size as bigint) as k, cast(128 as bigint) as n, p_partkey * 2 as nnz, p_partkey % 7 as window_num,
cast(p_size as bigint) as block_num, p_size / 64 as fill_rate, p_retailprice{add} as perf_us from part"""
LINE_8 = "'%-20s %-25s %6d %7d %10.2f %10.2f %10.2f %7.3fx'"
HALF = "round_even(v / greatest(power(2.0, floor(log2(v)) - 10), power(2.0, -24)), 0) * greatest(power(2.0, floor(log2(v)) - 10), power(2.0, -24))"

CORE = f"""with {A}, {COND}, {WIN}, n as (select (max(o_orderkey) + 16) // 16 as n from orders), aw as (select x.rw, coalesce(w.nblocks, 0) as nb from (select unnest(range((select n from n))) as rw) x left join w using (rw)),
st as (select rw, nb, sum(nb) over (order by rw) - nb as s from aw), tt as (select sum(nb) as t from aw),
bd as (select c, c * (t // 24) + least(c, t % 24) as g0, (c + 1) * (t // 24) + least(c + 1, t % 24) as g1 from tt, (select unnest(range(24)) as c)),
pl as (select c, f.rw as rf, g0 - f.s as bs, l.rw + 1 as re, g1 - l.s as be from bd join st f on f.nb > 0 and g0 >= f.s and g0 < f.s + f.nb join st l on l.nb > 0 and g1 > l.s and g1 <= l.s + l.nb where g1 > g0),
ps as (select c, case when bs > 0 then rf else coalesce(lag(re) over (order by c), 0) end as rs, re, bs, be from pl)
select cast(bd.c as integer) as core, cast(coalesce(rs, n) as bigint) as rw_start, cast(coalesce(re, n) as bigint) as rw_end, cast(coalesce(bs, 0) as bigint) as blk_start, cast(coalesce(be, 0) as bigint) as blk_end from bd cross join n left join ps using (c)"""

QUERIES = {
    f.__name__: f
    for f in (
        spmm_orders_parts, spmm_users_events, spmm_dense_grid, spmm_f16, coo_dedup_sum, coo_dedup_last, csr_row_ptr, bcsr_blocks,
        condensed_positions, condensed_windows, condensed_blocks, gather_list, fill_rates, core_split_24, jaccard_pairs, knn_topn,
        lsh_pairs, mkst_order, dtc_order, spmm_reordered_restored, spmm_blocked, spmm_rowvec, spmm_wide_128, spmm_tiled_128, streamed_product, verify_close,
        verify_mismatches, perf_by_group, perf_grand_total, perf_compare, perf_summary, perf_only_one_side, mean_time_by_timer,
        spmm_embeddings, bcsr_values, csr_round_trip, bounds_filter, bounds_dropped, skew_expanded, padded_order, permuted_rows, mtx_entries,
        mtx_meta, mtx_skew_entries, window_array, reorder_map, core_table, reused_table, gather_text, block_metadata, log_rows, log_counts,
        log_last_rows, reorder_log_rows, timing_log_rows, profiler_times, delimited_rows, valid_times, samples_in_order, category_lines,
        compare_lines, dumped_grid, lsh_recall, compare_places, mkst_forest, order_laws,
    )
}

WIDE = f"with {A}, c as (select row, n, sum(val * {B_VAL}) as v from a, (select unnest(range(128)) as n) group by 1, 2) select row, cast(sum(v) as double) as row_sum, cast(max(v) as double) as row_max from c group by 1"
KNN = "e as (select i, j, inter / union_size as sim from pr union all select j, i, inter / union_size from pr), kn as (select i, j, sim from (select *, row_number() over (partition by i order by sim desc, j desc) as k from e) where k <= 64)"
#: A forest has as many edges at or above a similarity as the pairs there join nodes less the parts they make; labels of parts spread by least neighbors.
FOREST = """u as (select distinct least(i, j) as a, greatest(i, j) as b, sim from kn), lv as (select sim, row_number() over (order by sim desc) as t from (select distinct sim from u)),
g as (select t, a, b from u join lv on u.sim >= lv.sim), b as (select t, a, b from g union all select t, b, a from g),
cc as (select t, a as node, a as label, 0 as it from (select distinct t, a from b) union all
select * from (select c.t, c.node, least(any_value(c.label), min(o.label)) as label, any_value(c.it) + 1 as it from cc c join b on b.t = c.t and b.a = c.node join cc o on o.t = b.t and o.node = b.b where c.it < 40 group by 1, 2)),
f as (select t, count(*) - count(distinct label) as edges from cc where it = 40 group by 1)
select round(sim, 9) as sim, sum(edges)::bigint as edges from (select lv.sim, f.edges - coalesce(lag(f.edges) over (order by t), 0) as edges from f join lv using (t)) group by 1 having sum(edges) > 0"""

ORACLES = {
    "compare_places": f"with {SIDES}, {CMP} select 'speedup' as sort, row_number() over (order by speedup desc, category, sample) as place, category, sample from cm union all select 'abs', row_number() over (order by diff desc, category, sample), category, sample from cm",
    "mkst_forest": f"with recursive {A}, {PAIRS}, {KNN}, {FOREST}",
    "order_laws": "select name, n as rows, n as old, n as new, cast(0 as bigint) as first, n - 1 as last from (select max(o_orderkey) + 1 as n from orders), (values ('mkst'), ('dtc')) t(name)",
    "spmm_orders_parts": f"with {A} {SPMM}",
    "spmm_reordered_restored": f"with {A} {SPMM}",
    "spmm_blocked": f"with {A} {SPMM}",
    "spmm_rowvec": f"with {A} {SPMM}",
    "spmm_wide_128": WIDE,
    "spmm_tiled_128": WIDE,
    "streamed_product": f"with a as (select l_orderkey as row, l_partkey as col, arg_max(l_quantity, (l_linenumber, l_quantity)) as val from lineitem group by 1, 2) {SPMM}",
    "spmm_users_events": f"with k as (select event_type, row_number() over (order by event_type) - 1 as col from (select distinct event_type from events)), a as (select user_id as row, col, cast(count(*) as double) as val from events join k using (event_type) group by 1, 2) {SPMM}",
    "spmm_dense_grid": f"with {A}, c as ({SPMM}) select r as row, cast(g.n as integer) as n, coalesce(c.val, 0.0) as val from (select unnest(range((select max(o_orderkey) + 1 from orders))) as r) cross join {NS} g left join c on c.row = r and c.n = g.n",
    "spmm_f16": f"with h as (select l_orderkey as row, l_partkey as col, l_quantity / 10 as v from lineitem), a as (select row, col, sum(round_even(({HALF}) * 1048576, 0)) as val from h group by 1, 2) {SPMM}",
    "coo_dedup_sum": f"with {A} select row, col, val from a",
    "coo_dedup_last": "select l_orderkey as row, l_partkey as col, arg_max(l_quantity, (l_linenumber, l_extendedprice, l_shipdate, l_quantity)) as val from lineitem group by 1, 2",
    "csr_row_ptr": f"with {A}, r as (select row, count(*) as nnz from a group by 1) select row, nnz, cast(sum(nnz) over (order by row) - nnz as bigint) as start from r",
    "bcsr_blocks": f"with {A} select row // 16 as rw, col // 16 as bc, count(*) as nnz, col // 16 * 16 as col_start from a group by 1, 2",
    "condensed_positions": f"with {A}, {COND} select rw, col, pos from p",
    "condensed_windows": f"with {A}, {COND}, {WIN} select rw, ncols, nblocks, cast(sum(nblocks) over (order by rw) - nblocks as bigint) as start from w",
    "condensed_blocks": f"with {A}, {COND} select p.rw, pos // 16 as blk, row % 16 * 16 + pos % 16 as off, p.col, val from a join p on a.row // 16 = p.rw and a.col = p.col",
    "gather_list": f"with {A}, {COND}, z as (select rw, max(pos) as last from p group by 1), g as (select rw, last, unnest(range((last // 16 + 1) * 16)) as ix from z) select g.rw, ix // 16 as blk, ix % 16 as slot, p.col from g join p on p.rw = g.rw and p.pos = least(ix, last)",
    "fill_rates": f"with {A}, {COND}, {WIN}, f as (select (select count(*) from a) as nnz, (select count(*) from (select distinct row // 16, col // 16 from a)) as blocks, (select cast(sum(nblocks) as bigint) from w) as condensed_blocks) select nnz, blocks, condensed_blocks, round(nnz / (blocks * 256), 2) as fill_fraction, round(nnz / (condensed_blocks * 256), 2) * 256 as fill_mean, round(nnz / condensed_blocks, 2) as fill_per_block from f",
    "core_split_24": CORE,
    "core_table": CORE,
    "jaccard_pairs": f"with {A}, {PAIRS} select i, j, inter, union_size from pr",
    "knn_topn": f"with {A}, {PAIRS}, e as (select i, j, inter / union_size as sim from pr union all select j, i, inter / union_size from pr) select i, j from (select i, j, row_number() over (partition by i order by sim desc, j desc) as k from e) where k <= 64",
    "verify_close": f"with {A}, c as ({SPMM}) select count(*) as cells, cast(0 as bigint) as mismatches, cast(0 as double) as ratio, true as passed from c",
    "verify_mismatches": f"with {A}, c as ({SPMM}) select row, n, val + case row % 100 when 0 then 1 else -1 end as o, val as g, round(1 / val, 9) as rdiff from c where row % 100 < 2 and val <> 0 and 1 > 1e-6 + 1e-4 * abs(val)",
    "perf_by_group": f"with {BRAND}, g as (select category, sum(q) as total, count(*) as samples, avg(q) as mean from v group by 1) select category, total, samples, round(mean, 6) as mean, round(100 * total / sum(total) over (), 6) as pct from g",
    "perf_grand_total": f"with {BRAND} select category, sum(q) as total, count(*) as samples, round(avg(q), 6) as mean from v group by rollup (category)",
    "perf_compare": f"with {SIDES}, {CMP} select category, sample, base, opt, diff, round(speedup, 9) as speedup, verdict from cm",
    "perf_summary": f"with {SIDES}, {CMP} select count(*) as samples, count_if(verdict = 'improved') as improved, count_if(verdict = 'unchanged') as unchanged, count_if(verdict = 'regressed') as regressed, round(min(speedup), 6) as min_speedup, round(max(speedup), 6) as max_speedup, round(avg(speedup), 6) as mean_speedup, round(quantile_cont(speedup, 0.5), 6) as median_speedup, round(sum(base) / sum(opt), 6) as total_ratio from cm",
    "perf_only_one_side": f"with {SIDES} select category, sample, 'base' as side from b anti join o using (category, sample) union all select category, sample, 'opt' as side from o anti join b using (category, sample)",
    "mean_time_by_timer": "select event_type as timer, count(*) as runs, sum(round(value * 1000)) as total_ms, round(avg(round(value * 1000)), 6) as mean_ms from events group by 1",
    "spmm_embeddings": "with e as (select cast(label as bigint) as row, unnest(embedding) as x, unnest(range(len(embedding))) as n from embeddings) select row, cast(n as integer) as n, sum(floor(cast(x as double) * 1000)) as val from e group by 1, 2",
    "bcsr_values": f"with {A} select row // 16 as rw, col // 16 as bc, cast(256 as integer) as cells, sum(val) as total, sum(val * (row % 16 * 16 + col % 16)) as weighted from a group by 1, 2",
    "csr_round_trip": f"with {A} select row, col, val from a",
    "bounds_filter": f"with {A} select row, col, val from a where row < (select max(o_orderkey) + 1 from orders) // 2 and col < (select max(p_partkey) + 1 from part) // 2",
    "bounds_dropped": f"with {A} select count_if(row >= (select max(o_orderkey) + 1 from orders) // 2 or col >= (select max(p_partkey) + 1 from part) // 2) as dropped, count(*) as total from a",
    "skew_expanded": f"with {A} select row, col, val from a where row < col union all select col, row, -val from a where row < col",
    "padded_order": "select new_row, old_row from (select row_number() over (order by o_custkey, o_orderkey) - 1 as new_row, o_orderkey as old_row from orders) union all select i, i from (select max(o_orderkey) + 1 as m from orders), lateral (select unnest(range(m, (m + 15) // 16 * 16)) as i)",
    "permuted_rows": f"with {A} select new_row as row, col, val from a join (select row_number() over (order by o_custkey, o_orderkey) - 1 as new_row, o_orderkey as old_row from orders) on row = old_row",
    "mtx_entries": "select 'first' as category, 'lines' as matrix, l_partkey - 1 + 1 as row, l_suppkey as col, sum(l_quantity) as val from lineitem group by 3, 4",
    "mtx_meta": "select 'first' as category, 'lines' as matrix, (select max(p_partkey) + 1 from part) as m, (select max(p_partkey) + 1 from part) as k, count(*) as nnz, 'general' as symmetry, count(*) as stored from (select distinct l_partkey, l_suppkey from lineitem)",
    "mtx_skew_entries": "with h as (select l_partkey as row, l_suppkey as col, sum(l_quantity) as val from lineitem where l_partkey >= l_suppkey group by 1, 2) select row, col, val from h union all select col, row, -val from h where row <> col",
    "window_array": f"with {A}, {COND}, {WIN}, aw as (select x.rw, coalesce(w.nblocks, 0) as nb from (select unnest(range((select (max(o_orderkey) + 16) // 16 from orders))) as rw) x left join w using (rw)) select rw as idx, cast(sum(nb) over (order by rw) - nb as double) as value from aw",
    "reorder_map": "select new_row, old_row from (select row_number() over (order by o_custkey, o_orderkey) - 1 as new_row, o_orderkey as old_row from orders)",
    "reused_table": f"with {A} " + " union all ".join(f"select row // {n} as rw, col // {n} as bc, count(*) as nnz, col // {n} * {n} as col_start, {n} as block from a group by 1, 2, 4" for n in (16, 8)),
    "gather_text": f"with {A}, {COND}, z as (select rw, max(pos) as last from p group by 1), g as (select rw, last, unnest(range((last // 16 + 1) * 16)) as ix from z) select g.rw, ix // 16 as blk, string_agg(cast(p.col as varchar), ' ' order by ix) as cols from g join p on p.rw = g.rw and p.pos = least(ix, last) group by 1, 2",
    "block_metadata": f"with {A}, {COND}, {WIN}, f as (select (select count(*) from a) as nnz, (select count(*) from (select distinct row // 16, col // 16 from a)) as blocks, (select cast(sum(nblocks) as bigint) from w) as condensed_blocks) select 'NNZ' as key, cast(nnz as varchar) as value from f union all select 'BLOCKS', cast(blocks as varchar) from f union all select 'CONDENSED_BLOCKS', cast(condensed_blocks as varchar) from f",
    "log_rows": LOG.format(add=""),
    "log_counts": "select count_if(p_partkey % 10 <> 0) as read, count_if(p_partkey % 10 = 0) + 1 as rejected from part",
    "log_last_rows": LOG.format(add=" + 1"),
    "reorder_log_rows": "select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts, o_orderstatus as category, 'o' || o_orderkey as sample, o_orderkey as m, o_custkey as k, cast(128 as bigint) as n, o_orderkey * 3 as nnz, round(o_totalprice, 2) as perf, case when o_orderkey % 2 = 0 then 'SUCCESS' else 'SKIPPED (no golden file)' end as verify from orders",
    "timing_log_rows": "select 'u' || user_id as sample, event_type as timer, 1 as run, sum(round(value * 1000)) as ms from events group by 1, 2",
    "profiler_times": "select p_retailprice as perf_us from part",
    "delimited_rows": LOG.format(add=""),
    "valid_times": "with t as (select case when l_linenumber = 2 then 0.0 else l_quantity end as x from lineitem) select false as zeros, count(*) as samples, round(avg(x), 6) as mean from t where x > 0 union all select true, count(*), round(avg(x), 6) from t where x >= 0",
    "samples_in_order": "select p_brand as category, cast(row_number() over (partition by p_brand order by 'p' || p_partkey, p_retailprice) as integer) as place, 'p' || p_partkey as sample from part",
    "category_lines": f"""with {BRAND}, g as (select category, count(*) as n, sum(q) as t, avg(q) as m, 100 * sum(q) / sum(sum(q)) over () as p from v group by 1)
select printf('%-15s %-10d %-15.2f %-15.2f %-10.2f', category, n, t, m, p) as line from g union all select printf('%-15s %-10d %-15.2f %-15.2f %-10.2f', 'total', count(*), sum(q), avg(q), 100.0) from v
union all select * from (values (repeat('-', 80)), (repeat('-', 80)), (repeat('-', 80)), (printf('%-15s %-10s %-15s %-15s %-10s', 'category', 'samples', 'total_us', 'mean_us', 'pct')))""",
    "compare_lines": f"""with {SIDES}, {CMP}, s as (select count(*) as n, count_if(verdict = 'improved') as i, count_if(verdict = 'unchanged') as u, count_if(verdict = 'regressed') as r,
min(speedup) as lo, max(speedup) as hi, avg(speedup) as me, quantile_cont(speedup, 0.5) as md, sum(base) as tb, sum(opt) as t_o from cm)
select printf({LINE_8}, category, sample, 1, 2, base, opt, diff, speedup) as line from cm
union all select * from (values (repeat('-', 100)), (repeat('-', 100)), (printf('%-20s %-25s %6s %7s %10s %10s %10s %8s', 'Category', 'Sample', 'M', 'Blocks', 'Base(us)', 'Opt(us)', 'Diff(us)', 'Speedup')))
union all select unnest([printf('samples: %d', n), printf('improved: %d, unchanged: %d, regressed: %d', i, u, r), printf('total: baseline=%.2fus, optimized=%.2fus, ratio=%.3fx', tb, t_o, tb / t_o),
printf('speedup: min=%.3fx, max=%.3fx, mean=%.3fx, median=%.3fx', lo, hi, me, md)]) from s
union all select printf('only in baseline: %d', count(*)) from (select category, sample from b except select category, sample from o)
union all select printf('only in optimized: %d', count(*)) from (select category, sample from o except select category, sample from b)""",
    "dumped_grid": f"with {A}, c as ({SPMM}) select row, string_agg(printf('%6.1f', val), chr(9) order by n) as line from c where n < 4 group by 1",
    "lsh_recall": f"with {A}, {PAIRS} select t::double as threshold, count_if(inter / union_size >= t) as pairs, cast(0 as bigint) as made_up, true as recalled from pr, (values (0.2), (0.35), (0.5), (0.8)) v(t) group by t",
}
