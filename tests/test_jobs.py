import datetime as dt
import json
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from hashlib import md5
from pathlib import Path

import pytest

from jobs import matrix_blocks, timing_tracker

DOCS = "doc_id long, lang string, text string, extra string"
ROOT = Path(__file__).resolve().parent.parent


def docs_rows():
    rows = [(i, ("en", "de", None)[i % 3], " ".join(f"w{(i * k) % 23}" for k in range(i % 9)), "x") for i in range(-5, 60)]
    return rows + [(7, "en", "second row of the id", "y"), (7, "en", None, "y"), (None, "en", "no id", "y"), (900, "fr", " \n", "y")]


def plain_blocks(rows, columns, block):
    """{lang: {(rw, blk): (cols, vals)}} by a plain walk."""
    cells = defaultdict(Counter)
    ids = defaultdict(set)
    for doc_id, lang, text, _ in rows:
        if doc_id is not None:
            ids[lang].add(doc_id)
            for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
                cells[lang][doc_id, int(md5(w.encode()).hexdigest()[:8], 16) % columns] += 1
    out = defaultdict(dict)
    for lang, c in cells.items():
        row = {d: i for i, d in enumerate(sorted(ids[lang]))}
        for w in {row[d] // block for d, _ in c}:
            cols = sorted({col for d, col in c if row[d] // block == w})
            for at in range(0, len(cols), block):
                mine = cols[at : at + block]
                vals = [0.0] * block * block
                for (d, col), n in c.items():
                    if row[d] // block == w and col in mine:
                        vals[row[d] % block * block + mine.index(col)] = float(n)
                out[lang][w, at // block] = (mine + [mine[-1]] * (block - len(mine)), vals)
    return out, {lang: len(v) for lang, v in ids.items()}


def read_blocks(spark, path):
    out = defaultdict(dict)
    for r in matrix_blocks.read_output(spark, path)[0].collect():
        out[r["lang"]][r["rw"], r["blk"]] = (r["cols"], r["vals"])
    return out


def test_blocks_of_each_language(spark, tmp_path):
    rows = docs_rows()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/docs")
    told = matrix_blocks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", {"columns": 50})
    want, sizes = plain_blocks(rows, 50, 16)
    assert read_blocks(spark, f"{tmp_path}/out") == want
    assert told == {"documents": len(rows), "without_id": 1, "blocks": sum(map(len, want.values())), "matrices": 4}
    lines = {r["lang"]: r for r in matrix_blocks.read_output(spark, f"{tmp_path}/out")[1].collect()}
    assert {k: r["m"] for k, r in lines.items()} == sizes
    for lang, r in lines.items():
        assert (r["k"], r["n"], r["blocks"], r["windows"]) == (50, 128, len(want.get(lang, {})), -(-sizes[lang] // 16))
        assert r["nnz"] == sum(sum(v != 0 for v in vals) for _, vals in want.get(lang, {}).values())
    assert matrix_blocks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", {"columns": 50}) == told
    assert read_blocks(spark, f"{tmp_path}/out") == want


def test_some_languages_replace_their_partitions_only(spark, tmp_path):
    rows = docs_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/a")
    changed = [(d, lang, "other words", x) for d, lang, _, x in rows if lang in ("de", "en")]
    spark.createDataFrame(changed, DOCS).write.parquet(f"{tmp_path}/b")
    matrix_blocks.run(spark, f"{tmp_path}/a", f"{tmp_path}/out", {"columns": 50})
    for _ in range(2):
        matrix_blocks.run(spark, f"{tmp_path}/b", f"{tmp_path}/out", {"columns": 50, "languages": ["de"]})
    old, new = plain_blocks(rows, 50, 16)[0], plain_blocks(changed, 50, 16)[0]
    assert read_blocks(spark, f"{tmp_path}/out") == old | {"de": new["de"]}
    # A whole run leaves nothing of languages that are gone.
    matrix_blocks.run(spark, f"{tmp_path}/b", f"{tmp_path}/out", {"columns": 50})
    assert read_blocks(spark, f"{tmp_path}/out") == new


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/docs")
    assert matrix_blocks.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out") == {"documents": 0, "without_id": 0, "blocks": 0, "matrices": 0}
    assert [t.count() for t in matrix_blocks.read_output(spark, f"{tmp_path}/out")] == [0, 0]


def test_config_names_are_checked(spark):
    with pytest.raises(ValueError, match="colums"):
        matrix_blocks.run(spark, "in", "out", {"colums": 3})


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(first, n, factor=1.0):
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(hours=i), i % 5, ("view", "click")[i % 2], (1 + i % 7) * (factor if i >= 360 else 1.0), "{}") for i in range(first, first + n)]


def plain_report(rows, days):
    sums = defaultdict(lambda: [0, 0])
    first = min(r[1] for r in rows).date()
    for _, ts, user, kind, value, _ in rows:
        if value is not None and 0 < value < float("inf"):
            s = sums[kind, str(user), (ts.date() - first).days < days]
            s[0] += round(value * 1000)
            s[1] += 1
    out = {}
    for kind, user, early in sums:
        if early and (kind, user, False) in sums:
            base, opt = (sums[kind, user, e][0] / sums[kind, user, e][1] for e in (True, False))
            out[kind, user] = (base, opt, "improved" if base / opt > 1.005 else "regressed" if base / opt < 0.995 else "unchanged")
    return out


def state(spark, out):
    report = {(r["category"], r["sample"]): (r["base"], r["opt"], r["verdict"]) for r in timing_tracker.table(spark, out, "report").collect()}
    daily = Counter()
    for r in timing_tracker.table(spark, out, "daily").collect():
        daily[r["day"], r["category"], r["sample"]] += r["total"]
    rejected = Counter()
    for r in timing_tracker.table(spark, out, "rejected").collect():
        rejected[r["reason"]] += r["events"]
    return report, daily, rejected


def plain_state(rows, days):
    daily, rejected = Counter(), Counter()
    for _, ts, user, kind, value, _ in rows:
        if value is None:
            rejected["null"] += 1
        elif value != value or abs(value) == float("inf"):
            rejected["not finite"] += 1
        elif value <= 0:
            rejected["zero" if value == 0 else "negative"] += 1
        else:
            daily[ts.date(), kind, str(user)] += round(value * 1000)
    return plain_report(rows, days), daily, rejected


def test_growing_events(spark, tmp_path):
    paths = (f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark")
    begun, conf = events(0, 400), {"base_days": 15, "files_per_batch": 1}
    spark.createDataFrame(begun, EVENTS).repartition(3).write.parquet(paths[0])
    told = timing_tracker.run(spark, *paths, conf)
    assert (told["taken"], told["batches"], told["rejected"]) == (400, 3, 0)
    assert state(spark, paths[1]) == plain_state(begun, 15)
    # Nothing new: nothing is taken, and the output stands.
    assert timing_tracker.run(spark, *paths, conf) == {"taken": 0, "rejected": 0, "batches": 0, "report": told["report"]}
    assert state(spark, paths[1]) == plain_state(begun, 15)
    # New files, with late events of days that were summed up already and times of no use.
    more = events(400, 200, 2.0) + events(90, 40) + [(-1, dt.datetime(2024, 1, 3), 1, "view", v, None) for v in (None, 0.0, -2.0, float("nan"), float("inf"))]
    spark.createDataFrame(more, EVENTS).coalesce(1).write.mode("append").parquet(paths[0])
    told = timing_tracker.run(spark, *paths, conf)
    assert (told["taken"], told["batches"], told["rejected"]) == (len(more), 1, 5)
    assert state(spark, paths[1]) == plain_state(begun + more, 15)
    assert {v[2] for v in state(spark, paths[1])[0].values()} >= {"regressed"}


def test_a_batch_that_is_done_twice_counts_once(spark, tmp_path):
    rows = events(0, 500)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events")
    timing_tracker.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark")
    # The mark of the batch is lost after its output was written: it is the same batch again.
    timing_tracker.run(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/other")
    assert state(spark, f"{tmp_path}/out") == plain_state(rows, 15)


def test_single_file_and_no_events(spark, tmp_path):
    rows = events(0, 30)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/all")
    (part,) = Path(f"{tmp_path}/all").glob("part-*.parquet")
    assert timing_tracker.run(spark, str(part), f"{tmp_path}/out", f"{tmp_path}/mark")["taken"] == 30
    Path(f"{tmp_path}/none").mkdir()
    assert timing_tracker.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/mark2") == {"taken": 0, "rejected": 0, "batches": 0, "report": 0}


def test_command_line(spark, tmp_path):
    spark.createDataFrame(docs_rows(), DOCS).write.parquet(f"{tmp_path}/docs")
    Path(f"{tmp_path}/own.json").write_text(json.dumps({"columns": 50}))
    args = ["--documents", f"{tmp_path}/docs", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json"]
    done = subprocess.run([sys.executable, "-m", "jobs.matrix_blocks", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr
    assert read_blocks(spark, f"{tmp_path}/out") == plain_blocks(docs_rows(), 50, 16)[0]
