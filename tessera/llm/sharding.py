"""Two-pass shuffle into shards.

Pass one scatters whole rows by seeded hash into shards, and within a shard into
buckets of a bounded mean size in bytes and in rows; a shard with more rows gets
more buckets. Pass two shuffles each bucket (Fisher-Yates with seeded draws),
numbers its rows and writes them. Since rows fall to buckets at random and
buckets are shuffled evenly, the order within a shard is a random one. Rows are
sorted by bucket, which Spark spills, so no bucket has to fit in memory. The
places of a bucket are 4 bytes each in one binary value, and a swap copies that
value: 16 KiB at 4096 rows, a cost for each row that doesn't follow the table.

The shard of a row depends on its id and the number of shards alone, by highest
random weight: a new shard takes rows only into itself. Null texts have size 1;
null ids fall to one shard. The bucket of a row and its place before the shuffle
follow from 128 bits over all its columns, so rows that share an id, or have
none, are spread over the buckets of their shard. Rows equal in all columns (in
these bits) that are more than a bucket's rows are counted, numbered anew and
spread by number. Repeated rows get slots of their own. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.store import stored
from tessera.llm.common import whole_row

SHARDS, SEED = 16, 7
#: Mean rows and bytes of a bucket at most, which is shuffled at once.
BUCKET_ROWS, BUCKET_BYTES = 4096, 64 << 20
#: Tasks that buckets are dealt to at most; beyond it a task does several, one after another.
MAX_TASKS = 20_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest seeded weight for this key."""
    weights = [F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*weights)["s"]


def bucket_hash(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("bucket"), *keys)


def bucket_of(keys: list[Column], buckets: int, seed: int = SEED) -> Column:
    return F.pmod(bucket_hash(seed, *keys), F.lit(buckets))


def fisher_yates(n: Column, *salt: Column) -> Column:
    """A seeded permutation of 0..n-1: from the last place down, each place swaps with one at or below it."""
    return _swapped(n, lambda: F.sequence(n - 1, F.lit(1), F.lit(-1)), salt)


def places_after(n: Column, *salt: Column) -> Column:
    """Where the same shuffle puts each of 0..n-1, its inverse: the same swaps from the first place up."""
    return _swapped(n, lambda: F.sequence(F.lit(1), n - 1), salt)


def _swapped(n: Column, steps, salt) -> Column:
    def at(a: Column, i: Column) -> Column:
        return F.substring(a, i * 4 + 1, F.lit(4))

    def draw(i: Column) -> Column:
        return F.struct(i.alias("i"), F.pmod(F.xxhash64(F.lit(SEED), *salt, i), i + 1).cast("int").alias("j"))

    def swap(a: Column, d: Column) -> Column:
        return F.overlay(F.overlay(a, at(a, d["j"]), d["i"] * 4 + 1, F.lit(4)), at(a, d["i"]), d["j"] * 4 + 1, F.lit(4))

    places = F.sequence(F.lit(0), n - 1)
    packed = F.unhex(F.array_join(F.transform(places, lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    unpacked = F.aggregate(F.transform(steps(), draw), packed, swap, lambda a: F.transform(places, lambda x: F.conv(F.hex(at(a, x)), 16, 10).cast("int")))
    return F.when(n < 2, places).otherwise(unpacked)


def digest_of(rows: DataFrame) -> Column:
    """128 bits that follow from all columns of a row; nulls count by their place."""
    columns = [x for c in rows.columns for x in (F.col(f"`{c}`"), F.isnull(f"`{c}`"))]
    return F.struct(*[F.xxhash64(F.lit(i), *columns).alias(f"h{i}") for i in range(2)])


def bytes_of(rows: DataFrame) -> Column:
    """About the bytes of a row: its strings and binary values, or its JSON form where other columns vary in length, and 8 for each column."""
    kinds = dict(rows.dtypes)
    nested = [f"`{c}`" for c, k in kinds.items() if k.startswith(("array", "struct", "map"))]
    plain = [F.octet_length(f"`{c}`") for c, k in kinds.items() if k in ("string", "binary")]
    sizes = plain + ([F.octet_length(F.to_json(F.struct(*nested)))] if nested else [])
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes), F.lit(8 * len(kinds)).cast("long"))


def numbered_copies(placed: DataFrame, kinds: DataFrame, most: int) -> DataFrame:
    """placed (shard, digest, r) + copy: 0, or of rows with more than `most` equal ones a number from 0.

    Such rows are reduced to one of a kind by partial aggregates and made again
    from its count, so their numbers need no sort of all of them.
    """
    many = kinds.filter(F.col("n") > most).select("shard", "digest", "n")
    kept = placed.join(many, ["shard", "digest"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    one = placed.join(many, ["shard", "digest"]).groupBy("shard", "digest").agg(F.first("r").alias("r"), F.first("n").alias("n"))
    parts = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}")))).repartition("shard", "digest", "part")
    numbers = F.sequence(F.col("part") * most, F.least("n", (F.col("part") + 1) * most) - 1)
    return kept.unionByName(parts.select("shard", "digest", "r", F.explode(numbers).alias("copy")))


def dealt_rows(rows: DataFrame, shards: int, seed: int, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """r (a whole row as a struct), shard, slot; slots are gapless from 0 in each shard."""
    digest = rows.select(shard_of(F.col("doc_id"), shards, seed).alias("shard"), digest_of(rows).alias("digest"), bytes_of(rows).alias("bytes"), whole_row(rows).alias("r"))
    kinds = digest.groupBy("shard", "digest").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    # One row for each shard.
    held = kinds.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most")).collect()
    buckets = {r["shard"]: max(1, -(-r["n"] // bucket_rows), -(-r["bytes"] // bucket_bytes)) for r in held}
    placed = digest.select("shard", "digest", "r")
    if any(r["most"] > bucket_rows for r in held):
        placed = numbered_copies(placed, kinds, bucket_rows)
    else:
        placed = placed.withColumn("copy", F.lit(0).cast("long"))
    within = F.array(*[F.lit(buckets.get(s, 1)).cast("long") for s in range(shards)])[F.col("shard")]
    placed = placed.withColumn("bucket", F.pmod(bucket_hash(seed, F.col("digest.h0"), F.col("digest.h1"), F.col("copy")), within))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n"))
    tasks = min(MAX_TASKS, max(1, sum(buckets.values())))
    # The shuffles are drawn where the buckets lie, and not by the few tasks that number them.
    places = places_after(F.col("n").cast("int"), F.col("shard"), F.col("bucket"))
    orders = base.repartition(tasks, "shard", "bucket").select("shard", "bucket", "base", places.alias("places"))
    at = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("digest.h0", "digest.h1")) - 1
    dealt = placed.repartition(tasks, "shard", "bucket").withColumn("at", at).join(orders.hint("merge"), ["shard", "bucket"])
    slot = F.col("base") + F.col("places")[F.col("at")]
    return dealt.select("r", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot")).sortWithinPartitions("shard", "slot")


def shuffle_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """rows with doc_id + shard, slot; slots are gapless from 0 in each shard."""
    return dealt_rows(rows, shards, seed, bucket_rows, bucket_bytes).select("r.*", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: read from the written shards of whole documents."""
    written = stored(dealt_rows(docs, shards, seed, BUCKET_ROWS, BUCKET_BYTES))
    out = written.select("shard", "slot", F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    size, crc = (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32")
    grown = shard_of(F.col("doc_id"), shards + 1, seed).cast("int")
    return out.select("doc_id", size, crc, F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole documents, a folder for each shard, rows in slot order within a file."""
    out = shuffle_rows(docs, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
