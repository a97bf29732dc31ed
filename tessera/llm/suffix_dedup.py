"""Removal of strings of WINDOW bytes that start at more than one place.

Every WINDOW-byte string has an anchor: its KGRAM-byte part of least hash,
leftmost if several tie. Equal strings have equal anchors at equal places, so
only strings whose anchor's hash occurs again can repeat. A run of strings with
one anchor is a segment. Segments of one anchor and one digest form a class with
a first member that stands for it. The first members of an anchor's classes are
brought together and the suffixes that start their strings are sorted: a
mergesort whose comparisons find the common extension by binary search over
prefix polynomial hashes. Neighbours that agree on WINDOW bytes are verified byte
by byte, and so is each member of a class against the first one. Should a digest
have put different bytes together, all is done again with another seed. Only
whole texts are told apart by a digest alone, 128 bits of their SHA-256.

Null texts are empty. Texts shorter than WINDOW bytes keep all. Equal texts are
worked on once; repeated rows each get a result. Other columns are ignored; an
empty table gives no rows.
"""

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.store import dropped, stored
from tessera.llm.common import text_or_empty

WINDOW, KGRAM = 200, 50
#: Bytes hashed at once, and strings sorted at once.
SLICE_BITS, SORT_STRINGS = 20, 300_000
#: Anchors of more segments are split by distance from the anchor, in ranges of these widths, until their groups are
#: no larger. Every string keeps all its equals.
LARGE_GROUP, WIDTHS = 2000, (25, 5, 1)
#: Up to so many keys of large groups travel to all executors; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 100_000

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << SLICE_BITS)
        inverse = pow(_BASE, -1, 2**64)
        _tables[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, inverse)]
    return _tables[0][:n], _tables[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the hash of data[i:j] times the base to the i."""
    up, _ = _powers(len(data))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % w, np.uint64(2**64 - 1)))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, lengths: np.ndarray, window: int = WINDOW, kgram: int = KGRAM):
    """(anchor, first, last, hash) of the segments of texts that lie one after another in data."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none, none
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(n)
    _, down = _powers(n)
    p = prefix_hashes(data)
    h = _mix((p[kgram:] - p[:-kgram]) * down[: n - kgram + 1])
    low = np.uint64((1 << SLICE_BITS) - 1)
    key = (h & ~low) | at[: len(h)].astype(np.uint64)
    key[at[: len(h)] + kgram > ends[: len(h)]] = np.uint64(2**64 - 1)
    least = _window_min(key, window - kgram + 1)
    starts = np.flatnonzero(at[: len(least)] + window <= ends[: len(least)])
    if not len(starts):
        return none, none, none, none
    anchor = (least[starts] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1))
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(starts) - 1]))
    a = anchor[first]
    return a, starts[first], starts[last], h[a].astype(np.int64)


ANCHORS = "h long, digest long, text_key binary, at int, n int, lead int, known boolean, deal long"


def _anchors(docs: DataFrame, seed: int) -> DataFrame:
    """A row for each segment. A task passes on two copies of a text at most; that it repeats is then known.

    The same holds for equal segments of one slice: two meet the others of their anchor, further ones, equal to these
    byte by byte, are `known` to repeat and are dealt out by their place, so a line that is everywhere is not dealt to
    one task.
    """
    most = (1 << SLICE_BITS) - 1

    def emit(items):
        data = b"".join(t for _, t, _ in items)
        lengths = np.array([len(t) for _, t, _ in items])
        a, first, last, h = segments(np.frombuffer(data, np.uint8), lengths)
        if not len(a):
            return None
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        doc = np.searchsorted(begin, first, side="right") - 1
        shift = np.array([s for _, _, s in items])[doc]
        view = memoryview(data)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(view[i : j + WINDOW], seed) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(a))
        digest = digest.astype(np.int64)
        keys = pa.array([k for k, _, _ in items], pa.binary()).take(pa.array(doc))
        at = (first - begin[doc] + shift).astype(np.int32)
        order = np.lexsort((digest, h))
        same = (h[order[2:]] == h[order[:-2]]) & (digest[order[2:]] == digest[order[:-2]])
        known = np.zeros(len(a), bool)
        whole = lambda x: view[first[x] : last[x] + WINDOW]
        for x, y in zip(order[2:][same].tolist(), order[:-2][same].tolist(), strict=True):
            known[x] = whole(x) == whole(y)
        text = np.frombuffer(b"".join(k[:8] for k, _, _ in items), np.uint64)[doc]
        deal = np.where(known, _mix(text + _mix(at.astype(np.uint64))).astype(np.int64), h)
        cols = [h, digest, keys, at, (last - first + 1).astype(np.int32), (a - first).astype(np.int32), known, deal]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["h", "digest", "text_key", "at", "n", "lead", "known", "deal"])

    def run(batches):
        copies: dict[bytes, int] = {}
        for batch in batches:
            held, size = [], 0
            for k, t in zip(batch.column("text_key").to_pylist(), batch.column("body"), strict=True):
                copies[k] = copies.get(k, 0) + 1
                if copies[k] > 2:
                    continue
                body = t.as_py()
                if len(body) < WINDOW:
                    continue
                for s in range(0, max(1, len(body) - WINDOW + 1), most - WINDOW + 1):
                    part = body[s : s + most]
                    if size + len(part) > most:
                        if (out := emit(held)) is not None:
                            yield out
                        held, size = [], 0
                    held.append((k, part, s))
                    size += len(part)
            if held and (out := emit(held)) is not None:
                yield out

    return docs.mapInArrow(run, ANCHORS)


REPEATS = "kind int, h long, digest long, text_key binary, at int, n int, lead int"
#: What a segment is: KNOWN to repeat, a MEMBER of a class that another one stands for, OPEN if it has none like it but
#: others of its anchor, and PARTNER or FIRST if it stands for its class, with or without other classes of its anchor.
KNOWN, OPEN, PARTNER, MEMBER, FIRST = 0, 1, 2, 3, 4
SEGMENT = ["h", "digest", "text_key", "at", "n", "lead"]


def _repeats(anchors: DataFrame) -> DataFrame:
    """The segments whose anchor's hash occurs again, with their kind."""

    def judge(t: pa.Table, seen: int, first: bool, final: bool):
        """(rows out, the last run's first row, its rows seen beyond that, whether it is its anchor's first run).

        Rows come by anchor and digest. Of a run that may go on, only the first row is held; `seen` and `first` tell
        of the rows of t's first run that came before.
        """
        h, d = t.column("h").to_numpy(), t.column("digest").to_numpy()
        new_h = np.concatenate(([first], h[1:] != h[:-1]))
        new_d = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        starts, run = np.flatnonzero(new_d), np.cumsum(new_d) - 1
        size = np.diff(np.append(starts, len(d)))
        size[0] += seen
        many = ~(new_h[starts] & np.append(h[starts[1:]] != h[starts[1:] - 1], True))
        many[-1] &= final
        ended = np.ones(len(starts), bool)
        ended[-1] = final
        again = size > 1
        kinds = {
            MEMBER: again[run] & ~new_d,
            OPEN: (many & ~again)[run],
            PARTNER: new_d & (many & again)[run],
            FIRST: new_d & (ended & ~many & again)[run],
        }
        rows = np.concatenate([np.flatnonzero(x) for x in kinds.values()])
        held = t.slice(int(starts[-1]), 1), int(size[-1]) - 1, bool(new_h[starts[-1]])
        if not len(rows):
            return None, *held
        kind = np.repeat(np.array(list(kinds), np.int32), [x.sum() for x in kinds.values()])
        out = t.take(pa.array(rows)).combine_chunks()
        cols = [pa.array(kind)] + [out.column(c).combine_chunks() for c in SEGMENT]
        return pa.RecordBatch.from_arrays(cols, ["kind", *SEGMENT]), *held

    def run(batches):
        rest, seen, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            known = t.filter(t.column("known"))
            if known.num_rows:
                yield from known.select(SEGMENT).add_column(0, "kind", pa.array(np.full(known.num_rows, KNOWN, np.int32))).combine_chunks().to_batches()
                t = t.filter(pc.invert(t.column("known")))
                if not t.num_rows:
                    continue
            out, rest, seen, first = judge(t if rest is None else pa.concat_tables([rest, t]), seen, first, False)
            if out is not None:
                yield out
        if rest is not None and (out := judge(rest, seen, first, True)[0]) is not None:
            yield out

    dealt = anchors.repartition("deal").drop("deal")
    return dealt.sortWithinPartitions("known", "h", "digest").mapInArrow(run, REPEATS)


class SuffixSorter:
    """Order of suffixes of a text, compared on their first `window` bytes."""

    def __init__(self, data: np.ndarray, window: int = WINDOW):
        self.data, self.window, self.p = data, window, prefix_hashes(data)
        self.down = _powers(len(data) + 1)[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over prefix hashes."""
        p, dx, dy, px, py = self.p, self.down[x], self.down[y], self.p[x], self.p[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.window, np.int64)
        for _ in range(int(self.window).bit_length()):
            mid = (low + high + 1) // 2
            same = (p[x + mid] - px) * dx == (p[y + mid] - py) * dy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        short = n < self.window
        n = np.where(short, n, 0)
        return short & (self.data[x + n] < self.data[y + n])

    def sort(self, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merges runs of doubling length within each bucket; begin and size are given for each place of order."""
        order = order.copy()
        place = np.arange(len(order)) - begin
        w, most = 1, int(size.max(initial=0))
        while w < most:
            run = place // w
            other = (run ^ 1) * w
            act = np.flatnonzero((size > w) & (other < size))
            me, right = order[act], (run[act] & 1).astype(bool)
            low = begin[act] + other[act]
            first = low.copy()
            high = begin[act] + np.minimum(other[act] + w, size[act])
            for _ in range(w.bit_length()):
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) // 2
                them, mine = order[mid], me[live]
                swap = right[live]
                # From the right run: the others that are not greater. From the left: those that are less.
                before = self.less(np.where(swap, mine, them), np.where(swap, them, mine)) ^ swap
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
            to = begin[act] + (run[act] & ~1) * w + (place[act] - run[act] * w) + (low - first)
            order[to] = me
            w *= 2
        return order

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two suffixes really agree on the window, byte by byte."""
        out, step = np.empty(len(x), bool), np.arange(self.window)
        for i in range(0, len(x), 20_000):
            a, b = x[i : i + 20_000], y[i : i + 20_000]
            out[i : i + 20_000] = (self.data[a[:, None] + step] == self.data[b[:, None] + step]).all(axis=1)
        return out


def repeated_strings(bodies: list[bytes], group: np.ndarray, lead: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For `count` strings from the start of each body: whether it equals one of another body of its group at the same
    distance from the anchor. Flags lie one body after another."""
    lengths = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    body = np.repeat(np.arange(len(bodies)), count)
    step = np.arange(len(body)) - np.repeat(np.cumsum(count) - count, count)
    pos = (np.cumsum(lengths) - lengths)[body] + step
    rel = lead[body] - step
    sorted_ = np.lexsort((rel, group[body]))
    g, r = group[body][sorted_], rel[sorted_]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(g)))
    bucket = np.cumsum(new) - 1
    flags = np.zeros(len(body), bool)
    many = size[bucket] > 1
    if not many.any():
        return flags
    picked, owner = sorted_[many], bucket[many]
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    lens = np.diff(np.append(starts, len(owner)))
    which = np.repeat(np.arange(len(starts)), lens)
    sorter = SuffixSorter(data, window)
    back = np.empty(len(data), np.int64)
    back[pos[picked]] = picked
    order = sorter.sort(pos[picked], starts[which], lens[which])
    near = np.flatnonzero(which[1:] == which[:-1])
    near = near[sorter.common(order[near], order[near + 1]) >= window]
    true = sorter.equal(order[near], order[near + 1])
    if true.all():
        flags[back[order[near]]] = flags[back[order[near + 1]]] = True
        return flags
    # A hash collision: this batch is settled by the strings themselves.
    raw, seen = data.tobytes(), {}
    for i, o in zip(picked.tolist(), owner.tolist(), strict=True):
        s = (o, raw[pos[i] : pos[i] + window])
        if s in seen:
            flags[i] = flags[seen[s]] = True
        seen[s] = i
    return flags


PIECES = "key long, kind int, text_key binary, at int, n int, lead int, width int, bytes binary"


def pieces(key: int, n: int, lead: int, raw: bytes, width: int, window: int = WINDOW):
    """(key, first string, n, lead, bytes) of a segment's parts: strings whose distances from the anchor lie in one
    range of `width`. The key hashes the bytes that all strings of the range share, so equal strings have equal keys;
    at width 1 these are the whole string."""
    far, least = lead, lead - n + 1
    while far >= least:
        block = far // width * width
        near = max(least, block)
        core = raw[lead - block : lead - block - width + 1 + window]
        digest = xxhash.xxh3_64_intdigest(core, (key + block) % 2**64)
        yield (digest ^ 1 << 63) - (1 << 63), lead - far, far - near + 1, far, raw[lead - far : lead - near + window]
        far = near - 1


def _packed(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["key", "kind", "text_key", "at", "n", "lead", "width", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _cut(joined: DataFrame) -> DataFrame:
    """The bytes of segments that are OPEN or stand for a class; those of large anchors in pieces of WIDTHS[0].

    Segments that stand for a class come a second time, of kind FIRST, keyed by it, to be compared with its members.
    """
    width = WIDTHS[0]

    def run(batches):
        for batch in batches:
            rows = []
            for key, body, parts in zip(batch.column("text_key").to_pylist(), batch.column("body"), batch.column("parts").to_pylist(), strict=True):
                raw = body.as_py()
                for p in parts:
                    held = raw[p["at"] : p["at"] + p["n"] - 1 + WINDOW]
                    if p["kind"] in (PARTNER, FIRST):
                        rows.append((p["h"], FIRST, p["digest"], p["at"], p["n"], p["lead"], 0, held))
                    if p["kind"] == FIRST:
                        pass
                    elif p["large"]:
                        rows += [(k, p["kind"], key, p["at"] + i, n, r, width, b) for k, i, n, r, b in pieces(p["h"], p["n"], p["lead"], held, width)]
                    else:
                        rows.append((p["h"], p["kind"], key, p["at"], p["n"], p["lead"], 0, held))
                    if len(rows) > 20_000:
                        yield _packed(rows)
                        rows = []
            if rows:
                yield _packed(rows)

    return joined.select("text_key", "body", "parts").mapInArrow(run, PIECES)


def _narrower(cut: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                rows += [(k, p["kind"], p["text_key"], p["at"] + i, n, r, width, b) for k, i, n, r, b in pieces(p["key"], p["n"], p["lead"], p["bytes"], width)]
            if rows:
                yield _packed(rows)

    return cut.select("key", "kind", "text_key", "at", "n", "lead", "bytes").mapInArrow(run, PIECES)


def _marked(keys: DataFrame) -> tuple[DataFrame, bool]:
    """keys, for broadcast only where their counted number is small, and whether there are any."""
    keys = stored(keys)
    n = keys.count()
    return (F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys), n > 0


def _settled(cut: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(pieces to be sorted, spans found without): groups of more than LARGE_GROUP pieces are split until they are
    small, or are one string, which then is known to repeat."""
    cut = stored(cut)
    sorts, rows = [cut.filter("width = 0")], cut.filter("width > 0")
    spans = None
    for width in (*WIDTHS[1:], 0):
        sums = [F.count("*").alias("c")] if width else [F.count("*").alias("c"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi")]
        large = rows.groupBy("key").agg(*sums).filter(F.col("c") > LARGE_GROUP)
        if not width:
            # Groups that a hash collision put together are sorted like small ones.
            large = large.filter("lo = hi")
        keys, some = _marked(large.select("key"))
        if not some:
            sorts.append(rows)
            break
        sorts.append(rows.join(keys, "key", "left_anti"))
        rows = rows.join(keys, "key", "left_semi")
        if width:
            rows = stored(_narrower(rows, width))
        else:
            spans = rows.filter(F.col("kind") == OPEN).select("text_key", F.col("at").alias("s"), (F.col("at") + WINDOW).cast("int").alias("e"))
    out = sorts[0]
    for more in sorts[1:]:
        out = out.unionByName(more)
    return out, spans


SPANS = "text_key binary, s int, e int"


def _sorted_spans(cut: DataFrame) -> DataFrame:
    """(text_key, s, e): repeated bytes of OPEN segments, by sorting the suffixes of each anchor's segments."""

    def settle(rows):
        h = np.array([r[0] for r in rows], np.int64)
        count = np.array([r[4] for r in rows])
        flags = repeated_strings([r[6] for r in rows], h, np.array([r[5] for r in rows]), count)
        out, end = [], np.cumsum(count)
        for i, r in enumerate(rows):
            if r[1] != OPEN:
                continue
            f = flags[end[i] - count[i] : end[i]]
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    out.append((r[2], r[3] + s, r[3] + e - 1 + WINDOW))
        if not out:
            return None
        k, s, e = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["text_key", "s", "e"])

    def run(batches):
        rows, strings, last = [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "kind", "text_key", "at", "n", "lead", "bytes")]
            for r in zip(*cols, strict=True):
                if strings > SORT_STRINGS and r[0] != last:
                    if (out := settle(rows)) is not None:
                        yield out
                    rows, strings = [], 0
                rows.append(r)
                strings += r[4]
                last = r[0]
        if rows and (out := settle(rows)) is not None:
            yield out

    return cut.drop("width").repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


KEPT = "text_key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, collided boolean"


def removed_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _remove(joined: DataFrame, bodies: bool = False) -> DataFrame:
    """What each text keeps; with `bodies`, the kept bytes too. `collided` tells that a member of a class is not what its class is."""

    def run(batches):
        for batch in batches:
            rows = []
            names = ("text_key", "copies", "spans", "claims")
            for body, key, copies, spans, claims in zip(batch.column("body"), *[batch.column(c).to_pylist() for c in names], strict=True):
                raw = body.as_py()
                collided = any(raw[x["at"] : x["at"] + len(x["bytes"])] != x["bytes"] for x in claims or ())
                runs = [(0, len(raw))] if copies > 1 and len(raw) >= WINDOW else removed_runs([(x["s"], x["e"]) for x in spans or ()])
                at, kept = 0, []
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                rest = b"".join([*kept, raw[at:]])
                row = (key, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), collided)
                rows.append((*row, rest) if bodies else row)
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * bodies
                names = ["text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "collided"] + ["kept"] * bodies
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return joined.select("text_key", "body", "copies", "spans", "claims").mapInArrow(run, KEPT + ", kept binary" * bodies)


def _kept(keyed: DataFrame, seed: int, bodies: bool) -> DataFrame:
    repeats = stored(_repeats(_anchors(keyed.select("text_key", "body"), seed)))
    texts = keyed.groupBy("text_key").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    sorts = repeats.filter(F.col("kind").isin(OPEN, PARTNER))
    large, some = _marked(sorts.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > LARGE_GROUP).select("h"))
    told = repeats.filter(F.col("kind").isin(OPEN, PARTNER, FIRST)).join(large.withColumn("large", F.lit(True)), "h", "left")
    digest = F.unhex(F.lpad(F.hex("digest"), 16, "0")).alias("digest")
    part = F.struct("kind", "h", digest, "at", "n", "lead", F.coalesce("large", F.lit(False)).alias("large"))
    cut = stored(_cut(texts.join(told.groupBy("text_key").agg(F.collect_list(part).alias("parts")), "text_key")))
    pieces_, known = cut.filter(F.col("kind") != FIRST), None
    if some:
        pieces_, known = _settled(pieces_)
    found = _sorted_spans(pieces_)
    end = (F.col("at") + F.col("n") - 1 + WINDOW).cast("int")
    whole = repeats.filter(F.col("kind") != OPEN).select("text_key", F.col("at").alias("s"), end.alias("e"))
    spans = found.unionByName(whole) if known is None else found.unionByName(known).unionByName(whole)
    # The bytes that each member of a class should have, those of the segment that stands for it.
    firsts = cut.filter(F.col("kind") == FIRST).select(F.col("key").alias("h"), F.col("text_key").alias("digest"), "bytes")
    claims = repeats.filter(F.col("kind") == MEMBER).select("h", digest, "text_key", "at").join(firsts, ["h", "digest"])
    told = spans.select("text_key", F.struct("s", "e").alias("span"), F.lit(None).cast("struct<at:int,bytes:binary>").alias("claim")).unionByName(
        claims.select("text_key", F.lit(None).cast("struct<s:int,e:int>").alias("span"), F.struct("at", "bytes").alias("claim"))
    )
    told = told.groupBy("text_key").agg(F.collect_set("span").alias("spans"), F.collect_list("claim").alias("claims"))
    kept = stored(_remove(texts.join(told, "text_key", "left"), bodies))
    dropped(repeats, cut)
    return kept


def remove_repeats(docs: DataFrame, bodies: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `bodies` also kept (binary)."""
    digest = F.substring(F.unhex(F.sha2(text_or_empty(), 256)), 1, 16)
    keyed = docs.select("doc_id", digest.alias("text_key"), text_or_empty().cast("binary").alias("body"))
    for seed in count(1):
        kept = _kept(keyed, seed, bodies)
        if kept.filter("collided").isEmpty():
            return keyed.select("doc_id", "text_key").join(kept.drop("collided"), "text_key").drop("text_key")
        dropped(kept)
