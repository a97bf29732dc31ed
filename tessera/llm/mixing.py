"""Mixing sources to target weights.

Documents are summed up by membership pattern (the set of sources that they
belong to). A min-cost flow sends each pattern's words, at a cost that rises
with every repetition, to the sources' quotas. Each pattern's share is then
spread over its documents: whole repetitions for all, the rest for a seeded
prefix of them.

Nothing is collected but a few sums: sources are ranked and given their targets
as a table. A source that shares no pattern with others needs no flow, for its
quota is what it gives. Only patterns of overlapping sources are routed, one
connected part of them in one task; a part's size is its number of patterns and
not of documents.

Null texts have size 0; a null source comes last. Repeated rows are documents.
Documents without a source, or of size 0, are never taken; the former have no
source size and no target. Rows that share an id are drawn each for itself, by
id and text; rows equal in both are told apart by their place in a stored table,
which decides only which of equals is taken. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.store import dropped, stored
from tessera.llm.common import text_or_empty, whole_row, words_of
from tessera.operators.components import components

#: Fixed values of the mix.
WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix-1"
#: Hex digits of the seeded key by which the rank search narrows down, and rows that one task may order.
BUCKET_DIGITS, LEAF_ROWS = 3, 20_000
#: Tables of sources and patterns of so many rows travel to all executors; larger ones are joined by a shuffle, their hot rows dealt to SALTS tasks.
MAX_BROADCAST_ROWS, SALTS = 200_000, 16


def ranked(sizes: DataFrame, weights) -> DataFrame:
    """sizes(source, size) + weight, which goes round by rank; sources by code point, null last.

    Ranges of sources are numbered apart and the ranges' counts added up, so no task sorts all sources.
    """
    ordered = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())
    start, at = {}, 0
    for part, n in counts:
        start[part] = at
        at += n
    starts = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("part")) if start else F.lit(0)
    rank = starts + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ordered.select("source", "size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))


def with_targets(sources: DataFrame, total: int, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources(source, size, weight) + target: shares of the total by weight; what is above a source's cap is shared again by weight.

    One level is sought such that the weights times it, each cut at its cap, add up to the total. Every round is one
    sum over the sources; capped ones stay capped, so the rounds end, in practice after a few.
    """
    cap, level, done = F.col("size") * F.lit(float(max_repeats)), None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        n, held, whole = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        if whole is None or n == done:
            break
        level, done = max(0.0, total - held) / whole, n
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def flow(capacity: dict, members: dict, quota: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """Words taken from each pattern, by a min-cost flow to the sources' quotas.

    The k-th repetition of a pattern has room for its size and costs k, and all
    other arcs are free, so shortest augmenting paths of cost k are those of a
    largest flow with the first k repetitions open: the levels are solved one
    after another, each by blocking flows.
    """
    graph: dict = defaultdict(list)  # node -> arcs [to, room, index of the reverse arc]

    def arc(a, b, room):
        graph[a].append([b, room, len(graph[b])])
        graph[b].append([a, 0.0, len(graph[a]) - 1])
        return graph[a][-1]

    inlets = {p: arc("from", ("p", p), 0.0) for p in capacity}
    for p in capacity:
        for s in members[p]:
            arc(("p", p), ("s", s), float("inf"))
    for s, q in quota.items():
        arc(("s", s), "to", float(q))
    least = 1e-6

    def depths() -> dict:
        depth, queue = {"from": 0}, deque(["from"])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > least and b not in depth:
                    depth[b] = depth[a] + 1
                    queue.append(b)
        return depth

    for _ in range(max_repeats):
        for p, x in inlets.items():
            x[1] += float(capacity[p])
        while "to" in (depth := depths()):
            place: dict = defaultdict(int)
            path = ["from"]
            while path:
                a = path[-1]
                if a == "to":
                    arcs = [graph[x][place[x]] for x in path[:-1]]
                    room = min(x[1] for x in arcs)
                    for x in arcs:
                        x[1] -= room
                        graph[x[0]][x[2]][1] += room
                    path = path[: next(i for i, x in enumerate(arcs) if x[1] <= least) + 1]
                    continue
                while place[a] < len(graph[a]):
                    b, room, _ = graph[a][place[a]]
                    if room > least and depth.get(b, -1) == depth[a] + 1:
                        path.append(b)
                        break
                    place[a] += 1
                else:
                    path.pop()
                    if path:
                        place[path[-1]] += 1
    return {p: graph[x[0]][x[2]][1] for p, x in inlets.items()}


def _routed(patterns: DataFrame, quotas: DataFrame, max_repeats: int) -> DataFrame:
    """(pid, took) for patterns(pid, members, size) of overlapping sources; quotas(source, target)."""
    named = quotas.select(F.col("source").alias("q"), "target")
    arcs = patterns.select("pid", "size", F.explode("members").alias("source")).join(named, F.col("source").eqNullSafe(F.col("q")))
    arcs = stored(arcs.select("pid", "size", "source", "target"))
    # A source links its patterns to the least of them.
    first = arcs.groupBy("source").agg(F.min("pid").alias("least"))
    links = arcs.join(first.withColumnRenamed("source", "f"), F.col("source").eqNullSafe(F.col("f"))).select(F.col("pid").alias("a"), F.col("least").alias("b"))
    roots = components(links)
    parts = arcs.join(roots.withColumnRenamed("node", "pid"), "pid", "left").withColumn("root", F.coalesce("root", "pid"))

    def solve(key, table):
        capacity, members, quota = {}, defaultdict(list), {}
        for r in table.select(["pid", "size", "source", "target"]).sort_by([("pid", "ascending"), ("source", "ascending")]).to_pylist():
            capacity[r["pid"]] = r["size"]
            members[r["pid"]].append(r["source"])
            quota[r["source"]] = r["target"]
        took = flow(capacity, members, quota, max_repeats)
        return pa.table({"pid": pa.array(list(took), pa.int64()), "took": pa.array(list(took.values()), pa.float64())})

    out = stored(parts.groupBy("root").applyInArrow(solve, "pid long, took double"))
    dropped(arcs)
    return out


def _plan(sized: DataFrame, weights, max_repeats: int) -> DataFrame:
    """(members, source_size, target, whole, rest) of each pattern with a source; the facts are those of its first source."""
    patterns = stored(sized.groupBy("members").agg(F.sum("size").alias("size")).filter(F.size("members") > 0).withColumn("pid", F.monotonically_increasing_id()))
    total, widest = patterns.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max(F.size("members"))).first()
    by_source = patterns.select("pid", "size", F.explode("members").alias("source")).groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("patterns"))
    sources = with_targets(ranked(by_source.select("source", "size"), weights), total, max_repeats)
    head = F.element_at("members", 1)
    facts = patterns.join(sources.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target"), head.eqNullSafe(F.col("s"))).drop("s")
    if (widest or 0) < 2:
        facts = facts.withColumn("took", F.col("target"))
    else:
        shared = by_source.filter("patterns > 1").select(F.col("source").alias("shared"))
        touching = patterns.select("pid", F.explode("members").alias("s")).join(shared, F.col("s").eqNullSafe(F.col("shared"))).select("pid")
        wide = patterns.filter(F.size("members") > 1).select("pid")
        open_ = patterns.join(touching.union(wide).distinct(), "pid")
        facts = facts.join(_routed(open_, sources, max_repeats), "pid", "left").withColumn("took", F.coalesce("took", "target"))
    share = F.when(F.col("size") > 0, F.col("took") / F.col("size")).otherwise(0.0)
    whole = F.floor(share + 1e-12).cast("long")
    out = stored(facts.select("members", "source_size", "target", whole.alias("whole"), F.greatest(F.col("took") - whole * F.col("size"), F.lit(0.0)).alias("rest")))
    dropped(patterns)
    return out


def _beside(rows: DataFrame, facts: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """rows + facts by members, without dealing all rows of a large source to one task. `small`: the facts were counted and may be broadcast."""
    names = [c for c in facts.columns if c != "members"]
    facts = facts.select(F.col("members").alias("of"), *names)
    if small:
        return rows.join(F.broadcast(facts), F.col("members") == F.col("of"), how).select(*rows.columns, *names)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    spread = facts.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(spread, (F.col("members") == F.col("of")) & (F.col("salt") == F.col("of_salt")), how).select(*rows.columns, *names)


def mix(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """rows(r, members array<string>, size, key) -> r, size, source_size, target, times.

    The order of a pattern's documents is that of their seeded key and, among
    equals, of their place in a stored table. The cut in it is found by sums over
    buckets of that order, which narrow down until the bucket that holds it has at
    most LEAF_ROWS rows; only those are put in order.
    """
    members = F.array_sort(F.array_distinct("members"))
    tie = F.md5(F.monotonically_increasing_id().cast("string"))
    rows = stored(rows.select("r", members.alias("members"), "size", F.concat("key", tie).alias("key")))
    plan = _plan(rows, weights, max_repeats)
    small = plan.count() <= MAX_BROADCAST_ROWS
    light = rows.select("members", "size", "key")
    cuts = plan.filter("rest > 0").select("members", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("base"))
    width, held, most = 0, [], LEAF_ROWS + 1
    while most > LEAF_ROWS:
        near = _beside(light, cuts, small).filter(F.substring("key", 1, width) == F.col("cut") if width else F.lit(True))
        width += BUCKET_DIGITS
        per = near.groupBy("members", "rest", "base", F.substring("key", 1, width).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        before = F.sum("n").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + F.col("base")
        hit = per.withColumn("at", before).filter((F.col("at") < F.col("rest")) & (F.col("at") + F.col("n") >= F.col("rest")))
        first = F.min(F.struct("bucket", "at", "rows")).alias("c")
        cuts = stored(hit.groupBy("members", "rest").agg(first).select("members", "rest", F.col("c.bucket").alias("cut"), F.col("c.at").alias("base"), F.col("c.rows").alias("rows")))
        held.append(cuts)
        most = cuts.agg(F.max("rows")).first()[0] or 0
        cuts = cuts.drop("rows")
    near = _beside(light, cuts, small).filter(F.substring("key", 1, width) == F.col("cut"))
    order = Window.partitionBy("members").orderBy("key")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    # The last key that is taken once more; all before it are too.
    last = near.withColumn("run", run).filter(F.col("run") - F.col("size") / 2 <= F.col("rest")).groupBy("members").agg(F.max("key").alias("upto"))
    ends = cuts.join(last.withColumnRenamed("members", "m"), F.col("members") == F.col("m"), "left").select("members", F.coalesce("upto", "cut").alias("upto"))
    facts = stored(plan.join(ends.withColumnRenamed("members", "m"), F.col("members") == F.col("m"), "left").select("members", "source_size", "target", "whole", "upto"))
    dropped(plan, *held)
    more = F.coalesce((F.col("key") <= F.col("upto")).cast("long"), F.lit(0))
    times = F.when((F.col("size") > 0) & F.col("whole").isNotNull(), F.least(F.col("whole") + more, F.lit(max_repeats))).otherwise(0)
    return _beside(rows, facts, small, "left").select("r", "size", "source_size", "target", times.cast("long").alias("times"))


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def sized(docs: DataFrame, r: Column, seed: str = SEED) -> DataFrame:
    """r, members, size, key for documents with one source each; the key follows from id and text."""
    text = text_or_empty()
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text).cast("string")))
    return docs.select(r.alias("r"), F.array("source").alias("members"), size_of(text).alias("size"), key.alias("key"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents with one source each."""
    mixed = mix(sized(docs, F.struct("doc_id")), weights, max_repeats)
    return mixed.select("r.doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed_copies(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    mixed = mix(sized(docs, whole_row(docs)), weights, max_repeats).filter("times > 0")
    return mixed.select("r", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("r.*")
