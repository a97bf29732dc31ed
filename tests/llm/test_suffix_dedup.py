import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from tessera.llm import suffix_dedup as S


def brute(texts, window=200):
    where = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            where[raw[i : i + window]].append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = b"\1" * window
    out = []
    for d, raw in enumerate(raws):
        kept = bytes(c for c, g in zip(raw, gone[d], strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone[d]) if g and (i == 0 or not gone[d][i - 1]))
        out.append((d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé ", k=8))
    make = lambda n: "".join(word() for _ in range(n))
    passage = make(60)
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 500, "ab" * 400]
    for _ in range(15):
        t = make(80)
        texts.append(t)
        if rng.random() < 0.5:
            cut = rng.randrange(1, len(t) - 1)
            texts.append(t[:cut] + "X" + t[cut:])
        if rng.random() < 0.3:
            texts.append(t)
        texts.append(make(20) + passage[rng.randrange(0, 200) :] + make(20))
    base = make(60)
    for i in range(30):
        at = rng.randrange(len(base))
        texts.append(base[:at] + str(i) + base[at:])
    texts.append(make(5) + (base + make(3)) * 3)
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
    got = sorted(tuple(r) for r in S.remove_repeats(docs).collect())
    assert got == brute(texts)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in S.remove_repeats(docs, bodies=True).collect()}
    assert all(hashlib.sha256(kept[r[0]]).hexdigest() == r[4] for r in got)


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BITS", 12)
    monkeypatch.setattr(S, "SORT_STRINGS", 500)
    texts = corpus() + ["".join(random.Random(9).choices("abcdef", k=9000))]
    texts.append(texts[-1][:7000] + "Q")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in S.remove_repeats(docs).collect()) == brute(texts)


def test_large_anchors_are_split(spark, monkeypatch):
    """A passage with other neighbours in each text, near 200 bytes and longer; groups of three pieces count as large."""
    monkeypatch.setattr(S, "LARGE_GROUP", 3)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, edge = make(420), make(180)
    texts = [make(150) + passage + make(150) for _ in range(12)] + [make(90) + passage[:203] + make(90) for _ in range(6)]
    texts += [edge + passage + make(20) for _ in range(5)] + [texts[0], "", None, passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert sorted(tuple(r) for r in S.remove_repeats(docs).collect()) == want
    monkeypatch.setattr(S, "MAX_BROADCAST_KEYS", 0)
    assert sorted(tuple(r) for r in S.remove_repeats(docs).collect()) == want


def test_runs_over_many_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = corpus()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(tuple(r) for r in S.remove_repeats(docs).collect()) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_digest_that_collides(spark, monkeypatch):
    """With the first seed all segments have one digest: members that differ from their class are found, and the next seed settles them."""

    class Weak:
        @staticmethod
        def xxh3_64_intdigest(data, seed):
            return 7 if seed == 1 else xxhash.xxh3_64_intdigest(data, seed)

    monkeypatch.setattr(S, "xxhash", Weak)
    seeds, kept = [], S._kept
    monkeypatch.setattr(S, "_kept", lambda keyed, seed, bodies: seeds.append(seed) or kept(keyed, seed, bodies))
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    core = make(120)
    texts = [make(140) + core + make(140) for _ in range(4)] + [make(300)] * 2 + [make(30) + core + make(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in S.remove_repeats(docs).collect()) == brute(texts)
    assert seeds == [1, 2]


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_and_collisions(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.choices(b"ab", k=600)) * 2
    data = np.frombuffer(raw, np.uint8)
    s = S.SuffixSorter(data, 40)
    at = np.array(rng.sample(range(len(raw) - 40), 300))
    got = s.sort(at, np.zeros(300, np.int64), np.full(300, 300))
    assert [raw[i : i + 40] for i in got] == sorted(raw[i : i + 40] for i in at)
    bodies = [b"x" * 30 + b"y" * 30, b"x" * 30 + b"z" * 30, b"q" + b"x" * 30 + b"y" * 30]
    args = (np.zeros(3, np.int64), np.array([5, 5, 6]), np.array([10, 10, 10]), 40)
    want = S.repeated_strings(bodies, *args)
    monkeypatch.setattr(S.SuffixSorter, "common", lambda self, x, y: np.full(len(x), self.window))
    assert (S.repeated_strings(bodies, *args) == want).all() and want.sum() == 18  # nine strings of the first body, nine of the last
