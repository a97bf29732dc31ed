"""Merkle trees over the rows of a table, one for each group, under one root.

Rows are sorted in ranges of (group, id) and written. Counts of each group's
rows in each partition, summed up over the partitions before it, give a row its
place in its group. Each run of a group in a partition then builds all aligned
subtrees that lie wholly in it; the roots of the largest ones, ragged at the
run's ends, are shuffled by their coordinates and finished to subtrees of
2^BLOCK leaves. Further rounds of STEP levels finish the trees. The groups' roots
are the leaves of the tree above them, built in the same way. Proofs come down
the same way: a block's path to the root is joined to its leaves, 2^BLOCK at
most, which add the steps inside the block. No task holds more than a block or
2^STEP nodes, however large a group is.

A node is the hash of its children; the last node of a level may have one child.
Leaves with the same id ascend by their hash; null ids come first, and null
groups are a group of their own, before all others. Rows that are equal in all
columns are leaves of their own, side by side, and their proofs are dealt to
them in any order. Columns besides those named don't matter. An empty table has
no rows, no subroot and no root.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.store import dropped, stored

#: Levels of a block of leaves, and levels that a round above it finishes.
BLOCK, STEP = 8, 10
#: Counted rows of offsets or groups that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: A missing value in a leaf; the first byte of a group's key, null before all names.
MISSING, NULL_GROUP, NAMED_GROUP = "-", "-", "="


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row's fields: each one's UTF-8 length, a colon and the value, or - for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit(MISSING)) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def group_key(name: Column) -> Column:
    """A key that is never null and sorts nulls first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit(NAMED_GROUP), name), F.lit(NULL_GROUP))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def next_level(nodes: dict[int, str], size: int) -> dict[int, str]:
    """The parents of a level of `size` nodes that all their children are there for."""
    out = {}
    for i in nodes:
        left, right = i & ~1, i | 1
        if left in nodes and (right in nodes or right >= size):
            out[i >> 1] = digest(*[nodes[k] for k in (left, right) if k < size])
    return out


def path_in(levels: list[dict[int, str]], sizes: list[int], i: int) -> list[str]:
    """The steps from node i upward: L or R and the sibling on that side, or N where there is none."""
    steps = []
    for nodes, size in zip(levels, sizes, strict=True):
        k = i ^ 1
        steps.append("N" if k >= size else ("L" if k < i else "R") + nodes[k])
        i >>= 1
    return steps


def climb(nodes: dict[int, str], size: int, steps: int) -> tuple[list[dict[int, str]], list[int], dict[int, str]]:
    """(levels, their whole sizes, what stands above): up to so many levels, ending at a group's root."""
    levels, sizes = [], []
    while size > 1 and len(levels) < steps:
        levels.append(nodes)
        sizes.append(size)
        nodes, size = next_level(nodes, size), (size + 1) // 2
    return levels, sizes, nodes


def complete_subtrees(first: int, hashes: list[str], n: int, height: int) -> list[tuple[int, int, str]]:
    """(level, index, hash) of the largest aligned subtrees within leaves first.. of one block of 2^height leaves, of a group of n."""
    nodes, level, size, out = {first + k: h for k, h in enumerate(hashes)}, 0, n, []
    while nodes:
        above = next_level(nodes, size) if level < height and size > 1 else {}
        out += [(level, i, h) for i, h in nodes.items() if i >> 1 not in above]
        nodes, level, size = above, level + 1, (size + 1) // 2
    return out


NODE = "g string, n long, level int, idx long, hash string"


def _runs(height: int):
    """Subtrees of leaves (g, n, i, hash) in order: a run ends where the group changes, a place is left out or a block ends."""

    def run(batches):
        key, first, held = None, 0, []
        for batch in batches:
            out = []
            for g, n, i, h in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "i", "hash")), strict=True):
                if held and (g != key[0] or i != first + len(held) or not i % (1 << height)):
                    out += [(*key, *x) for x in complete_subtrees(first, held, key[1], height)]
                    held = []
                if not held:
                    key, first = (g, n), i
                held.append(h)
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*key, *x) for x in complete_subtrees(first, held, key[1], height)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    g, n, level, idx, h = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(h)], ["g", "n", "level", "idx", "hash"])


def _finished_block(height: int):
    """The root of a block from the subtrees that runs have left of it."""

    def run(key, table):
        found = [{} for _ in range(height + 1)]
        for level, idx, h in zip(*(table.column(c).to_pylist() for c in ("level", "idx", "hash")), strict=True):
            found[level][idx] = h
        n = size = table.column("n")[0].as_py()
        nodes = found[0]
        for level in range(1, height + 1):
            if size == 1:
                break
            nodes, size = next_level(nodes, size) | found[level], (size + 1) // 2
        ((block, h),) = nodes.items()
        return pa.table({"g": [key[0].as_py()], "n": pa.array([n], pa.int64()), "idx": pa.array([block], pa.int64()), "hash": [h]})

    return run


def _finished_step(step: int):
    """Each node's path to the node `step` levels above it, and that node."""

    def run(table):
        idx, h, size = table.column("idx").to_pylist(), table.column("hash").to_pylist(), table.column("size")[0].as_py()
        levels, sizes, top = climb(dict(zip(idx, h, strict=True)), size, step)
        (up,) = top.values()
        paths = pa.array([path_in(levels, sizes, i) for i in idx], pa.list_(pa.string()))
        return pa.table({"g": table.column("g"), "n": table.column("n"), "idx": table.column("idx"), "path": paths, "up": [up] * len(idx)})

    return run


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves(g, hash, ...) + i, the place in its group, and n, the group's size; written in ranges of (g, order)."""
    # Rows that are equal in all these columns are told apart, so that no range has to hold all of them.
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).orderBy("g", *order, "_tie").drop("_tie")
    at = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = at.groupBy("g", "_part").agg(F.count("*").alias("_count"), F.min("_row").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("g", "_part", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"), F.sum("_count").over(Window.partitionBy("g")).alias("n"))
    offsets = stored(offsets)
    i = F.col("_offset") + F.col("_row") - F.col("_first")
    if offsets.count() <= BROADCAST_ROWS:
        joined = at.join(F.broadcast(offsets), ["g", "_part"])
    else:
        joined = at.join(offsets, ["g", "_part"]).repartition("_part").sortWithinPartitions("_part", "_row")
    return joined.withColumn("i", i).drop("_part", "_row", "_offset", "_first")


def block_paths(rows: DataFrame, height: int, step: int) -> DataFrame:
    """(g, idx, path array<string>, root) for each block of placed rows: the steps from the block's root to its group's."""
    nodes = rows.select("g", "n", "i", "hash").mapInArrow(_runs(height), NODE)
    blocks = stored(nodes.groupBy("g", F.expr(f"shiftright(idx, {height} - level)").alias("block")).applyInArrow(_finished_block(height), "g string, n long, idx long, hash string"))
    most, rounds, at = blocks.agg(F.max("n")).first()[0] or 0, [], height
    below = blocks
    while most > 1 << at:
        size = F.shiftright(F.col("n") - 1, at) + 1
        done = below.withColumn("size", size).groupBy("g", F.shiftright("idx", step).alias("above")).applyInArrow(_finished_step(step), "g string, n long, idx long, path array<string>, up string")
        done = stored(done)
        rounds.append(done)
        at += step
        below = stored(done.groupBy("g", F.shiftright("idx", step).alias("idx")).agg(F.first("n").alias("n"), F.first("up").alias("hash")).select("g", "n", "idx", "hash"))
    paths = below.select("g", "idx", F.array().cast("array<string>").alias("path"), F.col("hash").alias("root"))
    for done in reversed(rounds):
        above = paths.select("g", F.col("idx").alias("above"), F.col("path").alias("rest"), "root")
        lower = done.select("g", "idx", "path", F.shiftright("idx", step).alias("above"))
        paths = lower.join(above, ["g", "above"]).select("g", "idx", F.concat("path", "rest").alias("path"), "root")
    out = stored(paths)
    dropped(blocks, *rounds)
    return out


def with_proofs(rows: DataFrame, paths: DataFrame, carried: list[str], height: int) -> DataFrame:
    """Placed rows' columns g and `carried` + proof, all steps from leaf to the root that paths(g, idx, path, root) lead to, + subroot, root."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("g", *carried))

    def run(left, right):
        rest, subroot, root = (right.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        at = left.column("i").to_pylist()
        levels, sizes, _ = climb(dict(zip(at, left.column("hash").to_pylist(), strict=True)), left.column("n")[0].as_py(), height)
        out = left.select(["g", *carried])
        out = out.append_column("proof", pa.array([path_in(levels, sizes, i) + rest for i in at], pa.list_(pa.string())))
        return out.append_column("subroot", pa.array([subroot] * len(at), pa.string())).append_column("root", pa.array([root] * len(at), pa.string()))

    mine = rows.select("n", "i", "hash", "g", *[c for c in carried if c != "hash"]).groupBy("g", F.shiftright("i", height).alias("block"))
    return mine.cogroup(paths.groupBy("g", "idx")).applyInArrow(run, f"{schema}, proof array<string>, subroot string, root string")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    side, sibling = lambda s: F.substring(s, 1, 1), lambda s: F.substring(s, 2, 64)
    step = lambda h, s: F.sha2(F.when(side(s) == "L", F.concat(sibling(s), h)).when(side(s) == "R", F.concat(h, sibling(s))).otherwise(h), 256)
    return F.aggregate(proof, leaf, step)


def proof_hash(proof: Column) -> Column:
    """The hash of a proof's siblings, from the leaf upward."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, height: int = BLOCK, step: int = STEP) -> DataFrame:
    """(order, group, leaf, changed_leaf, proof array<string>, subroot, root) for each row of docs.

    A leaf hashes `fields` in their order. A step of a proof is L or R and the
    sibling on that side, or N where a node has none. `changed` replaces fields
    by other values; changed_leaf is the hash of the row with them.
    """
    changed = changed or {}
    fine = lambda c: F.col(f"`{c}`")
    leaves = docs.select(
        group_key(fine(group)).alias("g"), fine(order).alias("_id"), fine(group).alias("_group"),
        leaf_hash(*[fine(c) for c in fields]).alias("hash"), leaf_hash(*[changed.get(c, fine(c)) for c in fields]).alias("_changed"),
    )
    rows = placed(leaves, ["_id", "hash"])
    paths = block_paths(rows, height, step)
    tops = placed(paths.filter("idx = 0").select(F.lit("").alias("g"), F.col("g").alias("member"), F.col("root").alias("hash")), ["member"])
    above = with_proofs(tops, block_paths(tops, height, step).withColumn("subroot", F.lit(None).cast("string")), ["member"], height)
    above = stored(above.select(F.col("member").alias("g"), F.col("proof").alias("rest"), F.col("root").alias("whole")))
    led = paths.join(above, "g").select("g", "idx", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root"))
    out = with_proofs(rows, led, ["_id", "_group", "hash", "_changed"], height)
    return out.select(F.col("_id").alias(order), F.col("_group").alias(group), F.col("hash").alias("leaf"), F.col("_changed").alias("changed_leaf"), "proof", "subroot", "root")
