"""The jobs as registered queries: each runs twice into a folder of its own and returns all of its output."""

from pyspark.sql import functions as F

from jobs import matrix_blocks, timing_tracker
from tessera.functions.store import fresh_path
from tessera.operators import layout


def job1_matrix_blocks(spark, d):
    """Non-zero cells of all blocks with the columns they gather, and the languages' log lines."""
    path = fresh_path(spark)
    for _ in range(2):
        matrix_blocks.run(spark, f"{d}/documents.parquet", path)
    blocks, matrices = matrix_blocks.read_output(spark, path)
    cells = layout.stored_cells(blocks.select("lang", "rw", "blk", "cols", "vals")).withColumn("part", F.lit("cell"))
    cells = cells.select("part", "lang", "rw", "blk", "off", "col", "val")
    return cells.unionByName(matrices.withColumn("part", F.lit("matrix")), allowMissingColumns=True)


def job2_timing_tracker(spark, d):
    """Daily sums over all batches, rejected events by reason, and the report."""
    path = fresh_path(spark)
    for _ in range(2):
        timing_tracker.run(spark, f"{d}/events.parquet", path, f"{path}/checkpoint")
    daily, rejected, report = (timing_tracker.table(spark, path, name) for name in ("daily", "rejected", "report"))
    daily = daily.groupBy(F.lit("daily").alias("part"), F.col("day").cast("string").alias("day"), "category", "sample").agg(F.sum("total").alias("total"), F.sum("samples").alias("samples"))
    rejected = rejected.groupBy(F.lit("rejected").alias("part"), F.col("reason").alias("category")).agg(F.sum("events").alias("samples"))
    rounded = [F.round(c, 6).alias(c) for c in ("base", "opt", "diff", "speedup")]
    report = report.select(F.lit("report").alias("part"), "category", "sample", "verdict", *rounded)
    return daily.unionByName(rejected, allowMissingColumns=True).unionByName(report, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (job1_matrix_blocks, job2_timing_tracker)}

ORACLES = {
    "job1_matrix_blocks": r"""with w as (select lang, doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word from documents where doc_id is not null),
e as (select lang, doc_id, ('0x' || md5(word)[1:8])::bigint % 4096 as col, count(*)::double as val from w group by all),
r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as row from (select distinct lang, doc_id from documents where doc_id is not null)),
a as (select e.lang, row, col, val from e join r on e.doc_id = r.doc_id and e.lang is not distinct from r.lang),
p as (select lang, rw, col, row_number() over (partition by lang, rw order by col) - 1 as pos from (select distinct lang, row // 16 as rw, col from a)),
m as (select lang, count(*) as m from r group by 1), z as (select lang, count(*) as nnz from a group by 1),
b as (select lang, sum(bs)::bigint as blocks from (select lang, rw, (count(*) + 15) // 16 as bs from p group by 1, 2) group by 1)
select 'cell' as part, a.lang, p.rw, pos // 16 as blk, row % 16 * 16 + pos % 16 as off, a.col, val, null::bigint as m, null::bigint as k, null::bigint as n, null::bigint as nnz, null::bigint as windows, null::bigint as blocks, null::double as fill
from a join p on a.lang is not distinct from p.lang and row // 16 = p.rw and a.col = p.col
union all select 'matrix', m.lang, null, null, null, null, null, m, 4096, 128, coalesce(nnz, 0), (m + 15) // 16, coalesce(blocks, 0), case when blocks > 0 then round(nnz / (blocks * 256), 2) * 256 else 0.0 end
from m left join z on m.lang is not distinct from z.lang left join b on m.lang is not distinct from b.lang""",
    "job2_timing_tracker": """with g as (select ts::date as day, event_type as category, user_id::varchar as sample, round(value * 1000)::bigint as us from events where value > 0 and value < 'infinity'::double),
d as (select day, category, sample, sum(us)::bigint as total, count(*) as samples from g group by 1, 2, 3),
s as (select category, sample, sum(total) filter (day < f + 15) / sum(samples) filter (day < f + 15) as base, sum(total) filter (day >= f + 15) / sum(samples) filter (day >= f + 15) as opt from d, (select min(day) as f from d) group by 1, 2)
select 'daily' as part, day::varchar as day, category, sample, total, samples, null::varchar as verdict, null::double as base, null::double as opt, null::double as diff, null::double as speedup from d
union all select 'rejected', null, why, null, null, count(*), null, null, null, null, null from (select case when value is null then 'null' when isnan(value) or isinf(value) then 'not finite' when value < 0 then 'negative' when value = 0 then 'zero' end as why from events) where why is not null group by why
union all select 'report', null, category, sample, null, null, case when base / opt > 1.005 then 'improved' when base / opt < 0.995 then 'regressed' else 'unchanged' end, round(base, 6), round(opt, 6), round(base - opt, 6), round(base / opt, 6) from s where base is not null and opt is not null""",
}
