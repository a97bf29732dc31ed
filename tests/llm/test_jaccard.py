import random

import numpy as np

from tessera.llm import jaccard
from tessera.operators.components import components


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Word", "word"]
    texts = [None, "", " \n", "one", "ONE", "a b", "A b", "x " * 4000]
    shared = rng.choices(vocab, k=40)
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randrange(5, 150))
        if rng.random() < 0.4:
            base = shared + base
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    base = rng.choices(vocab, k=120)
    for _ in range(60):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "\n\t"]).join(t))
    return texts


def test_against_brute_force(spark):
    for seed, size, percent in ((1, 3, 90), (2, 5, 80)):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = sorted(tuple(r) for r in jaccard.similar_documents(docs, size, percent).collect())
        assert got == brute(texts, size, percent)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(docs).count() == 0
    docs = spark.createDataFrame([(5, "a b c d", "x"), (5, "a b c d", "x"), (2, "A b c d", "y"), (None, "q", "z")], "doc_id long, text string, n_shingles string")
    got = sorted((tuple(r) for r in jaccard.similar_documents(docs).collect()), key=str)
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (None, 1, None)]
    assert {r["doc_id"] for r in jaccard.keep_one(docs).collect()} == {2, None}


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(31)}) == 1 and len({got[i] for i in range(100, 140)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 31 + 40 + 2


def test_keep_one_of_repeated_rows_and_ids(spark):
    rows = [(2, "A b c d", "k"), (2, "a b c d", "k"), (2, "a b c d", "k"), (2, "e f g h", "m"), (7, "e f g h", "m"), (None, "q r s", "n"), (None, "q r s", "n"), (None, "t u v", "o"), (9, None, None), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = sorted((tuple(r) for r in jaccard.keep_one(docs, 2).collect()), key=str)
    assert [(d, t.lower() if t else t, k) for d, t, k in got] == [(2, "a b c d", "k"), (2, "e f g h", "m"), (9, None, None), (9, None, None), (None, "q r s", "n"), (None, "t u v", "o")]


def test_texts_of_few_words(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcde", k=250)) for _ in range(400)]
    texts += [" ".join([*t.split()[:248], "a", "b"]) for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    formed = []
    plain = jaccard._close_pairs

    def watched(open_, percent):
        out = plain(open_, percent)
        formed.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_close_pairs", watched)
    want = brute(texts, 3, 90)
    assert sorted(tuple(r) for r in jaccard.similar_documents(docs).collect()) == want
    assert formed[0] < len(texts) ** 2 / 2 / 50
    # Groups dealt in many blocks lose no pair.
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "CELLS", 64)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    assert sorted(tuple(r) for r in jaccard.similar_documents(docs).collect()) == want


def test_close_rows_keeps_what_can_link():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(5)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.95], rng.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets for _ in range(8)]
    n, pos, root = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64), np.arange(len(sets))
    rows = np.arange(len(sets))
    p, q = jaccard.close_rows(n, pos, root, np.array([jaccard.range_counts(s) for s in sets]), rows, rows, 80)
    found = set(zip(p.tolist(), q.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 80 * (n[i] + n[j] - inter):
                assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 4
