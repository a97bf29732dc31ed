"""Exact cosine links between embeddings, by dual traversal of cover trees.

Equal vectors form one class with a multiplicity. Classes are dealt into blocks
around pivots, each with a centre and a covering radius. A vector is sent to a
block's task only where the distance to the block's centre leaves room for a
link, so blocks apart from each other never meet. Each block gets a cover tree:
a root, and nested levels whose centres lie at least a radius apart and cover
their members within it, radii halving from level to level. Pairs of blocks walk
two trees at once, both nodes being split together: a pair of nodes is dropped
when even its nearest members could not link, taken whole when even its farthest
ones must, and else split; single pairs are decided by their cosine in double
precision.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; neither do vectors of different lengths. Repeated rows and ids are
vectors: rows that share an id each count, and share a component if they link.
Other columns are ignored. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.store import stored
from tessera.operators.components import components

THRESHOLD = 0.9
#: Classes of a block; vectors that pivots are chosen from, and pivots at most.
BLOCK_ROWS, SAMPLE, MAX_PIVOTS = 8192, 8192, 1024
#: Radii of the levels below the root, as distances of unit vectors. At cosine 0.9 two nodes of radius 1 reach farther than any
#: distance there is, so such a level could prune nothing and would only multiply the pairs of nodes to be looked at.
RADII = (0.5, 0.25, 0.125)
SLACK = 1e-4


def usable(e: Column) -> Column:
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner of each row): a greedy net in row order, worked on in chunks."""
    bound = 1 - radius * radius / 2  # cosine at this distance
    x = x.astype(np.float32)
    centres: list[int] = []
    owner = np.full(len(x), -1)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        todo = np.arange(len(part))
        if centres:
            cos = part @ x[centres].T
            inside = cos.max(axis=1) >= bound
            owner[at + todo[inside]] = cos[inside].argmax(axis=1)
            todo = todo[~inside]
        if not len(todo):
            continue
        own = part[todo] @ part[todo].T
        left = np.ones(len(todo), bool)
        alone = (own >= bound).sum(axis=1) <= 1
        for i in range(len(todo)):
            if alone[i]:
                owner[at + todo[i]] = len(centres)
                centres.append(at + int(todo[i]))
                left[i] = False
                continue
            if left[i]:
                take = left & (own[i] >= bound)
                take[i] = True
                owner[at + todo[take]] = len(centres)
                centres.append(at + int(todo[i]))
                left &= ~take
    return np.array(centres, np.int64), owner


class Tree:
    """Nodes of a cover tree over unit rows: centre, covering radius, members, children. Node 0 is the root."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        rows = np.arange(len(x))
        self._add(int((x @ x.sum(axis=0)).argmax()), rows)
        self.children[0] = self._split(rows, 0)
        self.centres = x[self.centre].astype(np.float32)
        self.radii = np.array(self.radius)

    def _add(self, centre: int, own: np.ndarray) -> int:
        far = float(np.sqrt(max(0.0, (2 - 2 * (self.x[own] @ self.x[centre])).max()))) if len(own) > 1 else 0.0
        self.centre.append(centre)
        self.radius.append(far)
        self.members.append(own)
        self.children.append(np.empty(0, np.int64))
        return len(self.centre) - 1

    def _split(self, rows: np.ndarray, level: int) -> np.ndarray:
        centres, owner = net(self.x[rows], RADII[level])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        out = []
        for k, c in enumerate(rows[centres].tolist()):
            own = rows[order[cuts[k] : cuts[k + 1]]]
            node = self._add(c, own)
            if len(own) > 1 and level + 1 < len(RADII):
                self.children[node] = self._split(own, level + 1)
            out.append(node)
        return np.array(out, np.int64)


def dual(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, same: bool, threshold: float = THRESHOLD):
    """(links of a's rows, links of b's rows, edges as row pairs). Links count multiplicities; edges connect what links connect."""
    eps = float(np.sqrt(2 - 2 * threshold))
    ca, cb = np.zeros(len(wa), np.int64), np.zeros(len(wb), np.int64)
    edges: list[tuple[int, int]] = []
    norm_a, norm_b = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)

    def exact(p: np.ndarray, q: np.ndarray) -> None:
        for at in range(0, len(p), 1024):
            i = p[at : at + 1024]
            cos = (raw_a[i] @ raw_b[q].T) / (norm_a[i][:, None] * norm_b[q][None, :])
            link(i, q, cos >= threshold)

    def link(p: np.ndarray, q: np.ndarray, hit: np.ndarray) -> None:
        if same:
            hit = hit & (p[:, None] != q[None, :])
        if not hit.any():
            return
        ca[p] += hit @ wb[q]
        if not same:
            cb[q] += hit.T @ wa[p]
        # Rows and columns of one connected part get its least column as label; edges to it span the part.
        none = len(q)
        of_col = np.where(hit.any(axis=0), np.arange(len(q)), none)
        while True:
            of_row = np.where(hit, of_col[None, :], none).min(axis=1)
            least = np.minimum(of_col, np.where(hit, of_row[:, None], none).min(axis=0))
            if (least == of_col).all():
                break
            of_col = least
        rows, cols = np.flatnonzero(of_row < none), np.flatnonzero(of_col < none)
        some = np.zeros(none, np.int64)
        some[of_row[rows]] = rows
        edges.extend(zip(p[rows].tolist(), q[of_row[rows]].tolist(), strict=True))
        edges.extend(zip(p[some[of_col[cols]]].tolist(), q[cols].tolist(), strict=True))

    def pairs(na: np.ndarray, nb: np.ndarray) -> list[tuple[int, int]]:
        """Node pairs that are not pruned by their covering radii."""
        found = []
        xb, rb = b.centres[nb], b.radii[nb].astype(np.float32)
        for at in range(0, len(na), 1024):
            part = na[at : at + 1024]
            ra = a.radii[part].astype(np.float32)
            cos = a.centres[part] @ xb.T
            most = float(ra.max() + rb.max()) + eps + SLACK
            i, j = np.nonzero(cos >= np.float32(1 - most * most / 2 - SLACK))
            reach = ra[i] + rb[j] + np.float32(eps + SLACK)
            near = cos[i, j] >= 1 - reach * reach / 2 - SLACK
            found += zip(part[i[near]].tolist(), nb[j[near]].tolist(), strict=True)
        return found

    stack = [(0, 0)]
    while stack:
        m, n = stack.pop()
        p, q = a.members[m], b.members[n]
        d = float(np.sqrt(max(0.0, 2 - 2 * float(a.x[a.centre[m]] @ b.x[b.centre[n]]))))
        reach = a.radius[m] + b.radius[n]
        if d - reach > eps + SLACK:
            continue
        if d + reach < eps - SLACK:
            whole(p, q, wa, wb, ca, cb, edges, same)
        elif not len(a.children[m]) and not len(b.children[n]) or len(p) * len(q) <= 64:
            exact(p, q)
        else:
            stack += pairs(a.children[m] if len(a.children[m]) else np.array([m]), b.children[n] if len(b.children[n]) else np.array([n]))
    return ca, cb, edges


def whole(p, q, wa, wb, ca, cb, edges, same) -> None:
    """All pairs of two nodes link."""
    ca[p] += int(wb[q].sum())
    if same:
        ca[p] -= np.where(np.isin(p, q), wb[p], 0)
    else:
        cb[q] += int(wa[p].sum())
    edges.extend((int(i), int(q[0])) for i in p)
    edges.extend((int(p[0]), int(j)) for j in q)


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links, by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        i, j = find(x), find(y)
        if i != j:
            root[j] = i
            out.append((x, y))
    return out


def far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """k rows, each farthest from those before."""
    chosen, cos = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        nxt = int(cos.argmin())
        if cos[nxt] >= 1 - 1e-9:
            break
        chosen.append(nxt)
        cos = np.maximum(cos, x @ x[nxt])
    return x[chosen]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def choose_pivots(sample: np.ndarray, n: int, block_rows: int, eps: float) -> np.ndarray:
    """Pivots by a bounded sample: as many as blocks are needed, or more of them where vectors would then be sent to fewer tasks in all."""
    need, best = max(1, -(-n // block_rows)), None
    for k in sorted({min(MAX_PIVOTS, need), min(MAX_PIVOTS, 4 * need), min(MAX_PIVOTS, 16 * need), min(MAX_PIVOTS, 64 * need)}):
        pivots = far_apart(sample, k)
        d = distances(sample, pivots)
        cell = d.argmin(axis=1)
        radius = np.zeros(len(pivots))
        np.maximum.at(radius, cell, d[np.arange(len(sample)), cell])
        parts = np.maximum(1, np.ceil(np.bincount(cell, minlength=len(pivots)) / len(sample) * n / block_rows))
        sent = ((d <= radius + eps) * parts).sum() / len(sample)
        if best is None or sent < best[0] * 0.9:
            best = (sent, pivots)
    return best[1]


CELLED = "nid long, weight long, embedding array<double>, cell int, far double"


def _cells(classes: DataFrame, block_rows: int, eps: float) -> tuple[DataFrame, np.ndarray, int]:
    """classes + cell (its nearest pivot's) and far (the distance to it); pivots; their length. Vectors of other lengths have cell -1."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("nid")).limit(SAMPLE).select("embedding").collect() if n else []
    if not sample:
        return classes, np.empty((0, 0)), 0
    lengths = [len(r["embedding"]) for r in sample]
    width = max(sorted(set(lengths)), key=lengths.count)
    rows = np.array([r["embedding"] for r in sample if len(r["embedding"]) == width], np.float64)
    pivots = choose_pivots(unit(rows / np.abs(rows).max(axis=1, keepdims=True)), n, block_rows, eps)

    def run(batches):
        for batch in batches:
            x, at = _matrix(batch.column("embedding"), width)
            cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            if len(at):
                d = distances(x, pivots)
                cell[at] = d.argmin(axis=1)
                far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["nid", "weight", "embedding", "cell", "far"])

    return stored(classes.select("nid", "weight", "embedding").mapInArrow(run, CELLED)), pivots, width


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of one length, and their places."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    at = np.flatnonzero(np.diff(ends) == width)
    if not len(at):
        return np.empty((0, width)), at
    x = flat[ends[at][:, None] + np.arange(width)]
    return unit(x / np.abs(x).max(axis=1, keepdims=True)), at


OUT = "nid long, links long, other long"


def link_counts(classes: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(nid, links, null) with links to other classes' vectors, and (nid, null, other) edges that span the links."""
    eps = float(np.sqrt(2 - 2 * threshold))
    celled, pivots, width = _cells(classes, block_rows, eps)
    if not width:
        return classes.sparkSession.createDataFrame([], OUT)
    # A cell's blocks share its centre and covering radius; there are MAX_PIVOTS cells at most.
    first, parts, radius, base = {}, {}, np.zeros(len(pivots)), 0
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("cell").collect():
        first[r["cell"]], parts[r["cell"]] = base, -(-r["n"] // block_rows)
        base += parts[r["cell"]]
        if r["cell"] >= 0:
            radius[r["cell"]] = r["far"]
    known = sorted(c for c in first if c >= 0)
    centres, reach = pivots[known], radius[known] + eps + SLACK
    others = [[first[c] + i for i in range(parts[c])] for c in known]

    def sent(batches):
        for batch in batches:
            cell, nid = batch.column("cell").to_numpy(), batch.column("nid").to_numpy()
            x, at = _matrix(batch.column("embedding"), width)
            near = np.zeros((batch.num_rows, len(known)), bool)
            if len(at):
                near[at] = distances(x, centres) <= reach
            rows, lo, hi, own = [], [], [], []
            for i in range(batch.num_rows):
                c = int(cell[i])
                block = first[c] + int(_mix_one(int(nid[i])) % parts[c])
                for o in [first[-1] + k for k in range(parts[-1])] if c < 0 else [o for k in np.flatnonzero(near[i]) for o in others[k]]:
                    rows.append(i)
                    own.append(block)
                    lo.append(min(block, o))
                    hi.append(max(block, o))
                if len(rows) > 20_000:
                    yield _dealt(batch, rows, own, lo, hi)
                    rows, lo, hi, own = [], [], [], []
            if rows:
                yield _dealt(batch, rows, own, lo, hi)

    paired = celled.mapInArrow(sent, "nid long, weight long, embedding array<double>, block int, lo int, hi int")

    def run(key, table):
        lo, hi = key[0].as_py(), key[1].as_py()
        block = table.column("block").to_numpy()
        nid, weight = table.column("nid").to_numpy(), table.column("weight").to_numpy()
        vectors = np.empty(table.num_rows, object)
        lists = table.column("embedding").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i in range(len(vectors)):
            vectors[i] = flat[ends[i] : ends[i + 1]]
        sides = []
        for w in (lo, hi) if lo != hi else (lo,):
            sides.append(np.flatnonzero(block == w))
        counts, ea, eb = {}, [], []
        dims = {len(vectors[i]) for i in range(len(vectors))}
        for dim in dims:  # vectors of different lengths have no cosine
            at = [np.array([i for i in s if len(vectors[i]) == dim], np.int64) for s in sides]
            raws = [np.concatenate([*vectors[s], np.empty(0)]).reshape(len(s), dim) for s in at]
            raws = [r / np.where(len(r), np.abs(r).max(axis=1, keepdims=True, initial=0), 1) for r in raws]
            if not all(len(r) for r in raws):
                continue
            trees = [Tree(unit(r)) for r in raws]
            a, b = 0, len(raws) - 1
            ca, cb, edges = dual(trees[a], trees[b], weight[at[a]], weight[at[b]], raws[a], raws[b], lo == hi, threshold)
            for s, c in ((a, ca), (b, cb))[: len(raws)]:
                for i in np.flatnonzero(c):
                    counts[int(nid[at[s][i]])] = int(c[i])
            ea += [int(nid[at[a][i]]) for i, _ in edges]
            eb += [int(nid[at[b][j]]) for _, j in edges]
        forest = _forest(ea, eb)
        k = len(counts)
        none = [None]
        return pa.table(
            [
                pa.array([*counts, *(x for x, _ in forest)], pa.int64()),
                pa.array([*counts.values(), *none * len(forest)], pa.int64()),
                pa.array([*none * k, *(y for _, y in forest)], pa.int64()),
            ],
            ["nid", "links", "other"],
        )

    return stored(paired.groupBy("lo", "hi").applyInArrow(run, OUT))


def _mix_one(x: int) -> int:
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & (2**64 - 1)
    return x ^ (x >> 27)


def _dealt(batch, rows, own, lo, hi):
    picked = batch.take(pa.array(rows))
    kinds = [pa.array(v, pa.int32()) for v in (own, lo, hi)]
    return pa.RecordBatch.from_arrays([picked.column("nid"), picked.column("weight"), picked.column("embedding"), *kinds], ["nid", "weight", "embedding", "block", "lo", "hi"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    keyed = vectors.select("vec_id", e.alias("embedding")).withColumn("ok", usable(F.col("embedding")))
    key = F.when(F.col("ok"), F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")))
    keyed = keyed.withColumn("vec_key", key)
    one = keyed.filter("ok").groupBy("vec_key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = stored(one.select(F.monotonically_increasing_id().alias("nid"), "vec_key", "weight", "least", "embedding"))
    found = link_counts(classes.select("nid", "weight", "embedding"), threshold, block_rows)
    links = found.filter("links is not null").groupBy("nid").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select(F.col("nid").alias("a"), F.col("other").alias("b")))
    named = classes.select("nid", "vec_key", "weight", "least").join(roots.withColumnRenamed("node", "nid"), "nid", "left").join(links, "nid", "left")
    named = named.select("vec_key", "weight", "least", F.coalesce("root", "nid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = stored(named.join(whole, "root").select("vec_key", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = keyed.select("vec_id", "vec_key").join(result, "vec_key", "left")
    component = F.when(F.col("vec_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
