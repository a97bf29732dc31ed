import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions.joins import spread_join
from tessera.functions.prefix import running_sum_in_order
from tessera.operators import clusters
from tessera.operators import coo as C
from tessera.operators import forest as forests
from tessera.operators.clusters import merged
from tessera.operators.forest import depth_first, followed, maximum_forest, rooted, walked


def kruskal(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    forest = []
    for w, a, b in sorted(((-w, min(a, b), max(a, b)) for a, b, w in edges if a != b)):
        ra, rb = find(a), find(b)
        if ra != rb:
            up[ra] = rb
            forest.append((a, b, -w))
    return forest, {x: find(x) for x in up}


def plain_walk(forest):
    near = defaultdict(list)
    for a, b, w in forest:
        near[a].append((-w, b))
        near[b].append((-w, a))
    out, seen = [], set()
    for root in sorted(near):
        if root not in seen:
            todo, place = [root], 0
            while todo:
                v = todo.pop()
                seen.add(v)
                out.append((root, place, v))
                place += 1
                todo += [u for _, u in sorted(near[v], reverse=True) if u not in seen]
    return out


def random_edges(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 60)
    edges = [(rng.randrange(n) * 3 - 20, rng.randrange(n) * 3 - 20, rng.randrange(1, 6) / 4) for _ in range(rng.randrange(1, 3 * n))]
    return edges + edges[:3]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, w double").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_forest_and_walk(spark, seed):
    edges = random_edges(seed)
    forest, labels = maximum_forest(frame(spark, edges))
    want, parts = kruskal(edges)
    assert sorted(map(tuple, forest.collect())) == sorted(want)
    of = {r["node"]: r["part"] for r in labels.collect()}
    assert {x: of[x] for x in parts} == of and all((parts[a] == parts[b]) == (of[a] == of[b]) for a in parts for b in parts)
    walked = depth_first(rooted(forest, labels)).collect()
    assert sorted(map(tuple, walked)) == sorted(plain_walk(want))


def test_star_and_no_edges(spark):
    star = [(0, i, 1 / i) for i in range(1, 400)]
    forest, labels = maximum_forest(frame(spark, star))
    walked = depth_first(rooted(forest, labels)).collect()
    assert sorted(map(tuple, walked)) == [(0, i, i) for i in range(400)]
    forest, labels = maximum_forest(frame(spark, [(4, 4, 1.0)]))
    assert forest.count() == labels.count() == depth_first(rooted(forest, labels)).count() == 0


def test_long_chain(spark):
    n = 100_000
    chain = spark.range(n - 1).selectExpr("id as a", "id + 1 as b", "1.0 / (1 + id % 7) as w")
    labels = spark.range(n).selectExpr("id as node", "0L as part")
    walked = depth_first(rooted(chain, labels))
    assert walked.filter("root = 0 and place = row").count() == walked.count() == n


def test_followed_pointers(spark):
    rows = [(i, max(0, i - 1)) for i in range(37)] + [(100, 100)]
    got = followed(spark.createDataFrame(rows, "c long, up long")).collect()
    assert {(r["c"], r["up"]) for r in got} == {(i, 0) for i in range(37)} | {(100, 100)}


def test_running_sums_in_any_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = running_sum_in_order(df, ["g"], [df["k"].desc()], "v", "s").collect()
    assert len(got) == 300 and all(r["s"] == sum(v for g, k, v in rows if g == r["g"] and k > r["k"]) for r in got)


def plain_merge(pairs, cap, later_leads):
    """One walk through pairs(i, j, sim, turn) in order."""
    lead, size = {}, {}
    for i, j, _, _ in sorted(pairs, key=lambda p: (-p[2], -p[3], p[0], p[1])):
        for x in (i, j):
            lead.setdefault(x, x)
            size.setdefault(x, 1)
        if lead[i] == i and lead[j] == j and size[i] < cap and size[j] < cap:
            up, down = (i, j) if (size[i], (i < j) != later_leads) > (size[j], (j < i) != later_leads) else (j, i)
            lead[down] = up
            size[up] += size[down]

    def find(x):
        return x if lead[x] == x else find(lead[x])

    return {x: find(x) for x in lead}


@pytest.mark.parametrize("seed,cap,later", [(0, 4, True), (1, 16, False), (2, 1, True), (3, 8, False)])
def test_rounds_equal_one_walk(spark, seed, cap, later):
    rng = random.Random(seed)
    n = 60
    seen = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(200)}
    seen |= {(0, i) for i in range(1, n)} if seed == 1 else set()
    df = spark.createDataFrame([(i, j, rng.randrange(2, 9) / 10) for i, j in seen], "i long, j long, sim double").repartition(3)
    pairs = [tuple(r) for r in df.selectExpr("i", "j", "sim", "xxhash64(i, j)").collect()]
    got = {r["row"]: r["lead"] for r in merged(df, cap, later).collect()}
    assert got == plain_merge(pairs, cap, later)


@pytest.mark.parametrize(("arcs", "hub", "cap"), [(40, 1000, 4), (20, 12, 16), (1000, 5, 8)])
def test_walks_of_ranges_equal_one_walk(spark, monkeypatch, arcs, hub, cap):
    """Ranges of a few arcs, and rows with more arcs than a task holds."""
    monkeypatch.setattr(clusters, "LOCAL_ARCS", arcs)
    monkeypatch.setattr(clusters, "HUB_ARCS", hub)
    rng = random.Random(arcs)
    seen = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(150)} | {(0, i) for i in range(1, 50)}
    df = spark.createDataFrame([(i, j, rng.randrange(2, 9) / 10) for i, j in seen], "i long, j long, sim double").repartition(3)
    pairs = [tuple(r) for r in df.selectExpr("i", "j", "sim", "xxhash64(i, j)").collect()]
    assert {r["row"]: r["lead"] for r in merged(df, cap, True).collect()} == plain_merge(pairs, cap, True)


def test_bounded_pairs_need_no_rounds(spark, monkeypatch):
    """One task walks all pairs of a bounded range: a chain of rising similarity takes no round for each link."""
    monkeypatch.setattr(clusters, "spread_join", lambda *a: pytest.fail("rounds of joins"))
    chain = [(i, i + 1, (i + 1) / 100) for i in range(90)]
    df = spark.createDataFrame(chain, "i long, j long, sim double")
    pairs = [tuple(r) for r in df.selectExpr("i", "j", "sim", "xxhash64(i, j)").collect()]
    assert {r["row"]: r["lead"] for r in merged(df, 16, True).collect()} == plain_merge(pairs, 16, True)


def test_no_pairs(spark):
    assert merged(spark.createDataFrame([], "i long, j long, sim double"), 16, True).count() == 0


def test_growing_tables_are_not_broadcast(spark):
    """Files of numbers are small and their rows many: neither the salted join nor the grouped running sum leaves a broadcast to chance."""
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "key long, v long")
    summed = running_sum_in_order(pairs, ["key"], [F.col("v")], "v", "s")
    for df in (spread_join(pairs, pairs.withColumnRenamed("v", "w"), "key"), summed, C.permute_rows(pairs.withColumnRenamed("key", "row"), pairs.toDF("new_row", "old_row"))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bounded_graphs_need_no_joins_of_pointers(spark, monkeypatch):
    """A task contracts a range of parts and walks trees of bounded size by itself."""
    for name in ("followed", "rooted"):
        monkeypatch.setattr(forests, name, lambda *a: pytest.fail("rounds of joins"))
    edges = random_edges(7)
    forest, labels = maximum_forest(frame(spark, edges))
    want, _ = kruskal(edges)
    assert sorted(map(tuple, forest.collect())) == sorted(want)
    assert sorted(map(tuple, walked(forest, labels).collect())) == sorted(plain_walk(want))


@pytest.mark.parametrize(("arcs", "hub", "large"), [(10, 3, 3), (16, 1000, 0), (30, 4, 1000)])
def test_ranges_and_hubs_and_large_trees(spark, monkeypatch, arcs, hub, large):
    """Ranges of a few arcs, parts with more arcs than a task holds, trees above the size that a task walks."""
    for name, value in (("LOCAL_ARCS", arcs), ("HUB_ARCS", hub), ("LARGE_TREE", large), ("WALKED_EDGES", 5)):
        monkeypatch.setattr(forests, name, value)
    edges = random_edges(arcs) + [(0, i, i / 30) for i in range(1, 25)]
    forest, labels = maximum_forest(frame(spark, edges))
    want, parts = kruskal(edges)
    assert sorted(map(tuple, forest.collect())) == sorted(want)
    of = {r["node"]: r["part"] for r in labels.collect()}
    assert set(of) == set(parts) and all((parts[a] == parts[b]) == (of[a] == of[b]) for a in parts for b in parts)
    assert sorted(map(tuple, walked(forest, labels).collect())) == sorted(plain_walk(want))
