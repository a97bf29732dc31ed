"""Exact Jaccard links between documents' word shingles, and their components.

Documents with equal shingle sets form one class. Shingles are ordered rare
first; two sets can only be similar enough if they share a shingle of their
prefixes, at places and with lengths that leave room for the overlap. In large
groups that share a prefix shingle, all members are first compared with a few
pivots, which links most of such a group in linear work. All pairs that are
still in different components are then put to the length, positional and suffix
filters inside the task that holds the group, so none leaves it unfiltered; a
large group is dealt to tasks in pairs of blocks. Each pair is verified once, on
its whole sets.

Null and wordless texts have empty sets and link with nothing. Repeated rows
and repeated ids are rows of the same class. Other columns are ignored. An
empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.store import dropped, stored
from tessera.llm.common import whole_row
from tessera.operators.components import components

#: Shingle counts are kept in this many cells, a fixed size for any corpus; they only order shingles.
CELL_BITS, CHUNKS = 19, 256
#: Groups of more rows are first compared with so many pivots, in so many rounds. No pair is left out by this.
LARGE_GROUP, PIVOTS, ROUNDS = 16, 8, 2
#: Tasks that the classes of one component are dealt to when they look up its least id.
SALTS = 8
#: Ranges of hash in which a set's members are counted for the suffix filter.
RANGE_BITS = 6
#: Rows compared with one pivot in one task; rows of a block of a group, and cells of a filter's array at once.
PIVOT_ROWS, BLOCK_ROWS, CELLS = 512, 1024, 1 << 20
#: Hashes of words that a worker remembers, and shingles that it gathers before it counts them: bounds of its memory.
WORD_CACHE, COUNT_AT = 100_000, 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    acc = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[j : n - width + 1 + j]
    return np.unique(_mix(acc + np.uint64(width)))


def least_overlap(na: int, nb: int, percent: int) -> int:
    """The least intersection with 100 * inter >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


SKETCH = "doc_id long, n_shingles long, set_key binary, text_key string, chunk int, counts binary"


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """A light row for each document, and for each task its shingle counts in CHUNKS parts."""

    def run(batches):
        cells, parts, held = np.zeros(1 << CELL_BITS, np.uint32), [], 0

        def count():
            nonlocal held
            if parts:
                np.add(cells, np.bincount((np.concatenate(parts) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.uint32), out=cells)
            parts.clear()
            held = 0

        for batch in batches:
            ns, keys = [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), size)
                ns.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                parts.append(s)
                held += len(s)
                if held >= COUNT_AT:
                    count()
            if not ns:
                continue
            none = [None] * len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), batch.column("text_key"), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "text_key", "chunk", "counts"],
            )
        count()
        chunks = [p.astype("<u4").tobytes() for p in np.split(cells, CHUNKS)]
        none = [None] * CHUNKS
        yield pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.string()), pa.array(range(CHUNKS), pa.int32()), pa.array(chunks, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "text_key", "chunk", "counts"],
        )

    return docs.select("doc_id", "text", F.md5("text").alias("text_key")).mapInArrow(run, SKETCH)


def _counts(survey: DataFrame) -> np.ndarray:
    """The counts of all documents: a table of fixed size, summed on the executors."""

    def total(key, table):
        cells = sum(np.frombuffer(c.as_buffer(), "<u4").astype(np.int64) for c in table.column("counts"))
        return pa.table({"chunk": [key[0].as_py()], "counts": [np.minimum(cells, 2**32 - 1).astype("<u4").tobytes()]}, schema=pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    rows = survey.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect()
    out = np.zeros(1 << CELL_BITS, np.uint32)
    each = (1 << CELL_BITS) // CHUNKS
    for r in rows:
        out[r["chunk"] * each : (r["chunk"] + 1) * each] = np.frombuffer(r["counts"], "<u4")
    return out


def _classes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(nid, set_key, text_key, n, prefix, ranges) for each distinct non-empty set; prefix holds the rarest shingles in order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for t, key in zip(batch.column("text"), batch.column("text_key").to_pylist(), strict=True):
                s = shingle_set(t.as_py(), size)
                k = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or k in seen:
                    continue
                seen.add(k)
                order = np.lexsort((s, shared.value[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
                rows.append((k, key, len(s), s[order[: prefix_length(len(s), percent)]].astype(np.int64), range_counts(s)))
            if rows:
                k, key, n, p, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(key, pa.string()), pa.array(n, pa.int32()), pa.array(p, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.int32()))], ["set_key", "text_key", "n", "prefix", "ranges"])

    made = docs.select("text", F.md5("text").alias("text_key")).mapInArrow(run, "set_key binary, text_key string, n int, prefix array<long>, ranges array<int>")
    one = made.groupBy("set_key").agg(F.first(F.struct("text_key", "n", "prefix", "ranges")).alias("c"))
    return stored(one.select(F.monotonically_increasing_id().alias("nid"), "set_key", "c.text_key", "c.n", "c.prefix", "c.ranges"))


def _room(percent: int):
    """Length and positional filters for two rows that share a prefix shingle at places pos and other_pos."""
    n, m = F.col("n").cast("long"), F.col("other_n").cast("long")
    lengths = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    need = F.ceil((n + m) * percent / (100 + percent))
    reach = F.least(n - F.col("pos"), m - F.col("other_pos"))
    return lengths & (reach >= need)


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs(a, b) -> (a, b) that are similar enough. Each text travels once per pair; b's once per PIVOT_ROWS pairs."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts"))
    left = pairs.join(many, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = left.join(texts.withColumnRenamed("nid", "a"), "a").select("b", "part", "a", "text")
    heads = many.join(texts.withColumnRenamed("nid", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text"
    )

    def run(batches):
        key, head = None, None
        for batch in batches:
            out = []
            for b, part, a, t in zip(batch.column("b").to_pylist(), batch.column("part").to_pylist(), batch.column("a").to_pylist(), batch.column("text"), strict=True):
                s = shingle_set(t.as_py(), size)
                if a is None:
                    key, head = (b, part), s
                    continue
                if key != (b, part):
                    raise ValueError("a pair came without its pivot")
                need = least_overlap(len(s), len(head), percent)
                at = np.searchsorted(head, s)
                at[at == len(head)] = 0
                if int((head[at] == s).sum()) >= need:
                    out.append((a, b))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = heads.unionByName(left).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return rows.mapInArrow(run, "a long, b long")


def range_counts(s: np.ndarray) -> np.ndarray:
    """Members of a set in each range of hash."""
    return np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS).astype(np.int32)


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlap can be large enough: it is at most the sum of the lesser counts over the ranges."""
    side = lambda x: classes.select(F.col("nid").alias(x), F.col("n").cast("long").alias(f"n{x}"), F.col("ranges").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.filter(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, text) of wanted(nid, text_key), one text for each key."""
    one = docs.select(F.md5("text").alias("text_key"), "text").groupBy("text_key").agg(F.first("text").alias("text"))
    return stored(one.join(wanted, "text_key").select("nid", "text"))


def _rooted(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members + root, the component so far."""
    if found is None:
        return members.withColumn("root", F.col("nid"))
    at = members.join(found.withColumnRenamed("node", "nid"), "nid", "left")
    return at.select("token", "nid", "n", "pos", "own", F.coalesce("root", "nid").alias("root"))


def _pivot_pairs(at: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b) of the members of large groups with pivots in other components.

    Pivots are members with the fewest prefix shingles of their own, which lie
    in the middle of a group of variants; seeded hashes break ties. Least
    values find them, so a group's rows never meet in one task.
    """
    head = lambda i: F.min(F.struct("own", F.xxhash64("nid", F.lit(turn * PIVOTS + i)).alias("h"), "nid", "root", "n", "pos"))
    stats = at.groupBy("token").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), *[head(i).alias(f"p{i}") for i in range(PIVOTS)])
    large = stats.filter((F.col("c") > LARGE_GROUP) & (F.col("lo") < F.col("hi"))).select("token", F.array(*[f"p{i}" for i in range(PIVOTS)]).alias("ps"))
    seen = at.join(stored(large), "token").select("token", "nid", "n", "pos", "root", F.explode("ps").alias("p"))
    named = seen.select("nid", "n", "pos", "root", F.col("p.nid").alias("b"), F.col("p.n").alias("other_n"), F.col("p.pos").alias("other_pos"), F.col("p.root").alias("other_root"))
    hit = named.filter((F.col("root") != F.col("other_root")) & _room(percent))
    return hit.select(F.col("nid").alias("a"), "b").distinct()


def _fresh(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """Pairs that were not verified before, in either direction."""
    if done is None:
        return pairs
    both = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def close_rows(n: np.ndarray, pos: np.ndarray, root: np.ndarray, ranges: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """(left, right) rows of one shingle, in different components, whose overlap can be large enough by length, place and ranges of hash."""
    found = []
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        i = left[at : at + step][:, None]
        j = right[None, :]
        both = n[i] + n[j]
        need = -(-both * percent // (100 + percent))
        fits = (root[i] != root[j]) & (n[i] * 100 >= n[j] * percent) & (n[j] * 100 >= n[i] * percent) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
        if left is right:
            fits &= i < j
        x, y = np.nonzero(fits)
        need = need[x, y]
        x, y = left[at + x], right[y]
        for part in range(0, len(x), CELLS // 64):
            p, q = x[part : part + CELLS // 64], y[part : part + CELLS // 64]
            most = np.minimum(ranges[p], ranges[q]).sum(axis=1, dtype=np.int64)
            good = most >= need[part : part + CELLS // 64]
            found.append((p[good], q[good]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _close_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b) of open_(token, c, nid, n, pos, root, ranges) that pass all filters; c counts the rows of the token.

    A group of more than BLOCK_ROWS rows is dealt in blocks, and each pair of
    blocks is a task's group of its own; rows travel once for each block.
    """
    blocks = F.ceil(F.col("c") / BLOCK_ROWS).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("nid", "token"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = other.select("token", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "nid", "n", "pos", "root", "ranges")

    def judge(t: pa.Table):
        block, nid = t.column("block").to_numpy(), t.column("nid").to_numpy()
        n, pos, root = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "root"))
        lists = t.column("ranges").combine_chunks()
        ranges = lists.flatten().to_numpy().reshape(len(n), -1)
        key = [t.column(c).to_numpy() for c in ("token", "lo", "hi")]
        cuts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0), [True])))
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = np.arange(at, end)
            lo, hi = key[1][at], key[2][at]
            left = rows[block[at:end] == lo]
            right = left if lo == hi else rows[block[at:end] == hi]
            p, q = close_rows(n, pos, root, ranges, left, right, percent)
            if len(p):
                a, b = np.minimum(nid[p], nid[q]), np.maximum(nid[p], nid[q])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = np.ones(t.num_rows, bool)
            for c in ("token", "lo", "hi"):
                v = t.column(c).to_numpy()
                last &= v == v[-1] if len(v) else last
            whole = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if whole:
                yield from judge(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield from judge(rest)

    return keyed.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) over the classes that have links."""
    tokens = classes.select("nid", "n", F.posexplode("prefix").alias("pos", "token"))
    groups = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    shared = stored(tokens.join(groups, "token"))
    own = shared.groupBy("nid", "n").agg(F.count("*").alias("c")).select("nid", (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("c")).alias("own"))
    members = stored(shared.join(own, "nid"))
    dropped(shared)
    near = members.select("nid").distinct()
    texts = _texts(docs, near.join(classes.select("nid", "text_key"), "nid"))
    links = found = done = None
    held = []
    for turn in range(ROUNDS):
        pairs = _fresh(_pivot_pairs(_rooted(members, found), turn, percent), done)
        pairs = stored(_suffix_filter(pairs, classes, percent))
        held.append(pairs)
        if pairs.isEmpty():
            break
        more = stored(_verify(pairs, texts, size, percent))
        held.append(more)
        links = more if links is None else links.unionByName(more)
        done = pairs if done is None else done.unionByName(pairs)
        dropped(found)
        found = components(links)
    # What is left: rows of one shingle that are still in different components.
    at = _rooted(members, found)
    split = at.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("token", "c")
    open_ = at.join(split, "token").join(classes.select("nid", "ranges"), "nid")
    rest = stored(_fresh(_close_pairs(open_, percent), done))
    more = _verify(rest, texts, size, percent)
    out = components(more if links is None else links.unionByName(more))
    dropped(members, texts, rest, found, *held)
    return out


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, text_key, root (null without words), component_id for each row."""
    survey = stored(_survey(docs, size))
    light = survey.filter("chunk is null").select("doc_id", "n_shingles", "set_key", "text_key")
    classes = _classes(docs, _counts(survey), size, percent)
    roots = link_classes(docs, classes, size, percent)
    least = light.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = classes.select("nid", "set_key").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    named = stored(named.select("set_key", F.coalesce("root", "nid").alias("root"), F.col("root").isNotNull().alias("linked")).join(least, "set_key"))
    # Only classes with links look their component up; those of one component are dealt to SALTS tasks.
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    whole = named.filter("linked").groupBy("root").agg(F.min("least").alias("component_id")).select("root", "component_id", salt)
    linked = named.filter("linked").withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(SALTS))).join(whole, ["root", "salt"]).select("set_key", "root", "component_id")
    by_set = stored(linked.unionByName(named.filter("not linked").select("set_key", "root", F.col("least").alias("component_id"))))
    dropped(classes, named, roots)
    worded = F.col("n_shingles") > 0
    return light.join(by_set, "set_key", "left").select("doc_id", "n_shingles", "text_key", F.when(worded, F.col("root")).alias("root"), F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_documents(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def _rest_order(docs: DataFrame) -> Column:
    """An order of rows by all columns but id and text; maps, which have no order, by their JSON."""
    parts = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    return F.struct(F.lit(0), *parts)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that with the least doc_id (nulls last), then the least text key, then the least other columns in their order.

    So it is the same row however the table is dealt out. Wordless documents stay.
    """
    found = _grouped(docs, size, percent)
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "c")).alias("m")
    heads = stored(rows.filter("root is not null").groupBy("root").agg(first).select("m.doc_id", "m.text_key", "m.c"))
    wordless = rows.filter("root is null").select("doc_id", "text_key")
    key = F.md5("text")

    def among(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & key.eqNullSafe(keys["text_key"]), "left_semi")

    out = among(heads.filter("c = 1").select("doc_id", "text_key").unionByName(wordless))
    again = heads.filter("c > 1").select("doc_id", "text_key")
    if again.isEmpty():
        return out
    # Each task keeps one row of those that repeat an id and a text, so a large group of them never meets.
    least = among(again).groupBy("doc_id", F.md5("text").alias("_key")).agg(F.min_by(whole_row(docs), _rest_order(docs)).alias("_row"))
    return out.unionByName(least.select("_row.*"))
