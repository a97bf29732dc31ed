import numpy as np

from tessera.llm import cover_tree as C


def brute(rows, threshold=0.9):
    good = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i], np.float32).astype(float), np.array(rows[j], np.float32).astype(float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    return [(i, links[i], find(i), find(i) == i) for i in range(n)]


def vectors(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0, None] + [0.0] * (dim - 2), [1.0, 2.0]]
    for _ in range(60):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 8)):
            rows.append((base * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.3, 0.5])).tolist())
    rows += [rows[-1]] * 20 + [(np.array(rows[-1]) * 3).tolist()]
    return rows


def test_against_brute_force(spark):
    for seed, block in ((1, 8192), (2, 40)):
        rows = vectors(seed)
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(3)
        got = sorted(tuple(r) for r in C.near_duplicates(df, block_rows=block).collect())
        assert got == brute(rows)


def test_empty_and_useless(spark):
    schema = "vec_id long, embedding array<float>, kept string"
    assert C.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in C.near_duplicates(spark.createDataFrame([(3, None, "x")], schema)).collect()] == [(3, 0, 3, True)]


def test_tree_covers():
    x = C.unit(np.random.default_rng(3).normal(size=(700, 6)))
    t = C.Tree(x)
    for node in range(len(t.centre)):
        d = np.linalg.norm(x[t.members[node]] - x[t.centre[node]], axis=1)
        assert d.max() <= t.radius[node] + 1e-6
        if len(t.children[node]):
            assert sorted(np.concatenate([t.members[c] for c in t.children[node]])) == sorted(t.members[node])


def test_repeated_ids(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(5, base.tolist()), (5, base.tolist()), (5, (base * 2).tolist()), (3, (base + 0.01).tolist()), (None, base.tolist()), (9, rng.normal(size=8).tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, nid int, component_id int")
    got = sorted((tuple(r) for r in C.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 4, 3, False)] * 3 + [(3, 4, 3, True), (None, 4, 3, False), (9, 0, 9, True)], key=str)


def clustered(n, dim=32, clusters=24):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, dim))
    return [(centres[i % clusters] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.2])).tolist() for i in range(n)]


def test_blocks_apart_never_meet(spark):
    rows = clustered(1500)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in C.near_duplicates(df, block_rows=64).collect())
    assert got == brute(rows)
    x = C.unit(np.array(rows, np.float32).astype(float))
    pivots = C.choose_pivots(x, len(x), 64, 0.4473)
    d = C.distances(x, pivots)
    cell = d.argmin(axis=1)
    radius = np.array([d[cell == k, k].max(initial=0) for k in range(len(pivots))])
    share = (d <= radius + 0.4473).mean()
    print("share of vectors and cells that meet:", share)
    assert share < 0.15


def test_walk_prunes():
    x, y = C.unit(np.array(clustered(600))), C.unit(np.array(clustered(600))[::-1] * -1)
    a, b = C.Tree(x), C.Tree(y)
    ones = np.ones(600, np.int64)
    for p, q, same in ((a, a, True), (a, b, False)):
        cos = p.x @ q.x.T >= 0.9
        if same:
            np.fill_diagonal(cos, False)
        ca, cb, edges = C.dual(p, q, ones, ones, p.x, q.x, same)
        assert (ca == cos.sum(axis=1)).all() and (same or (cb == cos.sum(axis=0)).all())
        assert all(cos[i, j] or (same and i == j) for i, j in edges)
