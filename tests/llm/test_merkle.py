import hashlib
import zlib
from itertools import groupby

import duckdb
import pyspark.sql.functions as F
import pytest

from tessera.llm import merkle
from tessera.llm.queries import ORACLES, op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, add=0):
    n = None if r[4] is None else r[4] + add
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))


def tree(hashes):
    """(root, for each leaf its proof as a list of (sibling or None, whether it stands left))."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            proofs[k].append((level[j] if j < len(level) else None, j < i))
            at[k] = i // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], proofs


def brute(rows):
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    groups = [sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for _, g in groupby(sorted(rows, key=key), key)]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, proofs), rest in zip(groups, trees, above, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            steps = proof + rest
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for s, left in steps:
                h = sha(h if s is None else s + h if left else h + s)
            out.append((r[0], leaf(r), subroot, root, sha("".join(s for s, _ in steps if s)), h, h == root))
    return sorted(map(str, out))


def rows_of(n, langs=("en", "de", None, "é", "zz")):
    rows = [(i * 3, f"text {i}", langs[i * i % len(langs)], "a" if i % 3 else None, i) for i in range(n)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def got(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(str(tuple(r)) for r in op12_merkle_manifest(spark, str(tmp_path)).collect())


def test_query_against_a_plain_walk(spark, tmp_path):
    rows = rows_of(700, ("en", "en", "en", "de", None))
    rows += [(None, "no id", "en", None, 3), (None, None, None, None, None), (9, "same id", "en", "b", 1), (9, "", "en", "b", None)] + [(12, "again", "xx", "s", 4)] * 5
    assert got(spark, tmp_path, frame(spark, rows)) == brute(rows)


def test_query_against_its_sql(spark, tmp_path):
    rows = rows_of(90) + [(-1, None, None, None, None), (2**60, "漢字", "en", "s", 7)]
    mine = got(spark, tmp_path, frame(spark, rows))
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(map(str, c.execute(ORACLES["op12_merkle_manifest"]).fetchall())) == mine == brute(rows)


@pytest.mark.parametrize("height,step,parts", [(1, 1, 5), (2, 1, 1), (3, 2, 7)])
def test_small_blocks_many_rounds(spark, height, step, parts):
    rows = rows_of(83, tuple("abcdefg"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.manifest(frame(spark, rows, parts), fields, changed={"n_chars": F.expr("n_chars + int(crc32(string(doc_id)) % 7 = 0)")}, height=height, step=step)
    kept = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("p"), merkle.folded(F.col("changed_leaf"), F.col("proof")).alias("f"))
    assert sorted(str((*r, r[-1] == r["root"])) for r in kept.collect()) == brute(rows)


def test_offsets_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = rows_of(60)
    out = merkle.manifest(frame(spark, rows), ["doc_id", "source", "lang", "n_chars", "text"], height=2, step=2)
    assert {r["root"] for r in out.collect()} == {eval(brute(rows)[0])[3]}


def test_lone_leaf_and_empty_table(spark, tmp_path):
    rows = [(5, "x", "en", "s", 1)]
    assert got(spark, tmp_path, frame(spark, rows)) == brute(rows)
    assert merkle.manifest(frame(spark, []), ["doc_id", "text"]).count() == 0


def test_other_and_clashing_columns(spark):
    rows = rows_of(20)
    docs = frame(spark, rows).withColumns({"g": F.lit(1), "hash": F.lit("h"), "_id": F.lit(0), "n": F.lit(2), "i": F.lit(3), "_part": F.lit(4)})
    out = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"]).collect()
    assert sorted(r["leaf"] for r in out) == sorted(map(leaf, rows)) and {r["lang"] for r in out} == {r[2] for r in rows}


def test_large_group_of_equal_rows(spark, tmp_path):
    rows = [(1, "copy", "en", "s", 4)] * 600 + rows_of(50)
    assert got(spark, tmp_path, frame(spark, rows)) == brute(rows)
