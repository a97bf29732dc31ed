"""Token counts and best-two-fit packing into fixed-length sequences.

Null texts are empty and hold the end token alone. Repeated rows are packed as
often as they occur, null ids too. Of pieces of one length the one of the larger
document, piece and checksum goes first. Other columns are ignored, whatever their
names. An empty table gives no rows.
"""

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 2048, 0
#: Documents dealt to one packing group. Groups are packed apart; each leaves about one open sequence.
GROUP_DOCS = 4096
#: Bytes of text of a group at most on average, since a worker holds a group's ids, and tokens of a batch of pieces.
GROUP_BYTES, BATCH_TOKENS = 64 << 20, 4 << 20
#: Partitions that the groups are dealt to; with more groups a task takes several, one after another.
MAX_PARTS = 20_000
SPECIAL = "<|endoftext|>"

_encoders: dict[str, object] = {}


def encoder(json_path: str, ranks_path: str | None = None):
    """text -> uint32 ids. The rank file holds the same vocabulary and is faster; texts that it can't take go to the JSON tokenizer."""
    key = f"{json_path}|{ranks_path}"
    if key not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        exact = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if ranks_path is None:
            _encoders[key] = exact
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def both(text):
                if SPECIAL in text:
                    return exact(text)
                try:
                    return np.array(fast.encode_ordinary(text), dtype=np.uint32)
                except ValueError:
                    return exact(text)

            _encoders[key] = both
    return _encoders[key]


PIECES = "doc_id long, piece int, start long, length long, ids array<int>"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is left over."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document: ids, then END_ID, cut only where longer than the capacity."""

    def made(rows, ids):
        doc, piece, start, length = zip(*rows, strict=True)
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
        columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), flat]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    def pieces(batches):
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            rows, held, n = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                rows += [(doc, i, start, length) for i, (start, length) in enumerate(cut_points(len(ids), capacity))]
                held.append(ids)
                n += len(ids)
                if n >= BATCH_TOKENS:
                    yield made(rows, held)
                    rows, held, n = [], [], 0
            if rows:
                yield made(rows, held)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.

    Each bin is filled greedily with the longest items that fit. If a gap is
    left, its smallest item goes back for the two unpacked ones that fill the
    widened gap best, if they fill more of it.
    """
    order = np.argsort(lengths, kind="stable")[::-1]
    pools: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order:
        pools[lengths[i]].append(int(i))
    counts = np.array([len(p) for p in pools])
    mask = sum(1 << n for n in range(1, capacity + 1) if counts[n])
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    steps = np.arange(capacity + 1)

    def take(n: int) -> int:
        nonlocal mask
        counts[n] -= 1
        if not counts[n]:
            mask &= ~(1 << n)
        return pools[n].pop()

    number = 0
    while mask:
        held, gap = [], capacity
        while fit := mask & ((1 << (gap + 1)) - 1):
            n = fit.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and mask:
            least, item = held[-1]
            room = gap + least
            have = np.where(counts[: room + 1] > 0, steps[: room + 1], 0)
            below = np.maximum.accumulate(have)
            mate = below[room - steps[: room + 1]]
            lone = (mate == have) & (counts[: room + 1] < 2)
            mate = np.where(lone, below[np.maximum(mate - 1, 0)], mate)
            total = np.where((have > 0) & (mate > 0), have + mate, 0)
            a = int(total.argmax())
            if total[a] > least:
                held.pop()
                pair = (a, int(mate[a]))
                for n in pair:
                    held.append((n, take(n)))
                pools[least].append(item)
                counts[least] += 1
                mask |= 1 << least
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def checksums(ids: pa.ListArray) -> list[int]:
    """crc32 of each list's ids as little-endian 32-bit numbers."""
    flat, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
    return [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """pieces + ids_crc32, sequence_id, offset. Groups are dealt by a hash of document and place in the input, so equal rows spread, and packed one by one.

    Up to MAX_PARTS groups each group is a partition of its own, so what a task reads doesn't grow with the table.
    """
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(key, table):
        ids = table.column("ids").combine_chunks()
        ids = ids if isinstance(ids, pa.ListArray) else pa.concat_arrays(ids.chunks)
        table = table.append_column("ids_crc32", pa.array(checksums(ids), pa.int64()))
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        sequences = bins + key[1].as_py() * (1 << 40)
        return table.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets)).select(names)

    group = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    parts = min(groups, MAX_PARTS)
    keyed = pieces.withColumn("_group", group).withColumn("_part", F.pmod("_group", F.lit(parts)).cast("int"))
    return keyed.repartitionById(parts, "_part").groupBy("_part", "_group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents, their ids and their place in a sequence of at most `capacity` tokens."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, round(n / group_docs), -(-size // GROUP_BYTES))
    return pack(token_pieces(docs, json_path, ranks_path, capacity), groups, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (all tokens in order), parts (offset, length, doc_id, start of each piece): a row per sequence."""
    part = F.struct("offset", "length", "doc_id", "start", "ids")
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("held"))
    parts = F.transform("held", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id"), x["start"].alias("start")))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"), parts.alias("parts"))


def write_sequences(packed: DataFrame, path: str) -> None:
    """Whole sequences as training data."""
    sequences(packed).write.mode("overwrite").parquet(path)
