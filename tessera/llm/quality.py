"""Quality rules for single documents, and for hosts through their documents.

Null texts have no words and fail the base rules. Null hosts form a host of
their own. Repeated rows count as often as they occur. Columns of the same
names as the result's are replaced. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.store import stored
from tessera.llm.common import NOT_GAP, let, text_or_empty, words_of

#: Fixed values of the base rules and the symbols that they count.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PCT = "#*$%&|<>", 8, 20, 30
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Up to so many rejected hosts travel to all executors; more are joined by a shuffle.
MAX_BROADCAST_HOSTS = 100_000
#: Bounds of the prior's weight in documents: hosts no more alike than chance makes them get the largest one, and a host
#: of many documents is judged by its own rate under both.
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(w: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more.

    Texts whose windows all hash apart have none. The others compare the
    windows themselves, sorted, and add up the words that repeated ones cover.
    """
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    window = lambda i: F.slice(w, i + 1, F.lit(WINDOW))
    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))

    def covered(t: Column) -> Column:
        last = F.size(t) - 1
        same = lambda k: ((k > 0) & (t[k]["s"] == t[F.greatest(k - 1, F.lit(0))]["s"])) | (
            (k < last) & (t[k]["s"] == t[F.least(k + 1, last)]["s"])
        )
        hits = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda k: t[k]["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(a["end"], p.cast("long"))).cast("long").alias("n"),
            (p + WINDOW).cast("long").alias("end"),
        )
        return F.aggregate(hits, zero, step, lambda a: a["n"])

    tagged = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", window(i)).alias("s"), i.alias("i"))))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(w) > WINDOW) & repeats, let(tagged, covered)).otherwise(F.lit(0)).cast("long")


def word_stats(text: Column) -> Column:
    """struct(n_words, n_repeat_words)."""
    return let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PCT)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep + the base counts + base_failed."""
    t = text_or_empty()
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_GAP))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = docs.select(
        *keep,
        word_stats(t).alias("_w"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
    )
    out = counted.select(*keep, "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    return out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def host_rates(feats: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failed, rate, shrunk): failure rates shrunk by an empirical beta prior.

    The prior's mean is the corpus rate. Its weight follows from the spread of the
    hosts' rates, hosts weighted by their documents, less the spread that chance
    alone gives (method of moments): 1 / rho - 1 with rho the share of the spread
    that lies between hosts. It is kept within MIN_PRIOR and MAX_PRIOR.
    """
    per = feats.groupBy(host).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    per = per.withColumn("rate", F.col("failed") / F.col("n"))
    hosts, docs, m, m2 = per.agg(F.count("*"), F.sum("n"), F.sum("failed") / F.sum("n"), F.sum(F.col("failed") * F.col("rate")) / F.sum("n")).first()
    m = m or 0.0
    even = m * (1 - m)
    rho = ((m2 - m * m) * docs / even - hosts) / (docs - hosts) if even > 1e-12 and docs > hosts else 0.0
    prior = min(max(1 / rho - 1 if rho > 1e-12 else MAX_PRIOR, MIN_PRIOR), MAX_PRIOR)
    shrunk = (F.col("failed") + m * prior) / (F.col("n") + prior)
    return per.select(host, "n", "failed", "rate", shrunk.alias("shrunk"))


def rejected_hosts(feats: DataFrame, host: str = "source") -> DataFrame:
    """(_host), marked for broadcast only if their counted number is small, so texts are not dealt by host."""
    bad = stored(host_rates(feats, host).filter(F.col("shrunk") > MAX_HOST_RATE).select(F.col(host).alias("_host")))
    return F.broadcast(bad) if bad.count() <= MAX_BROADCAST_HOSTS else bad


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, kept. The light counts are stored once and used twice."""
    feats = stored(features(docs, ["doc_id", host]))
    bad = rejected_hosts(feats, host)
    joined = feats.join(bad.withColumn("_bad", F.lit(True)), feats[host].eqNullSafe(bad["_host"]), "left")
    kept = ~F.col("base_failed") & F.col("_bad").isNull()
    return joined.select("doc_id", *BASE, "base_failed", kept.alias("kept"))


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows that pass the base rules and whose host is not rejected, with their columns."""
    stats = stored(docs.select(host, word_stats(text_or_empty()).alias("_w")).select(host, base_failed(F.col("_w.n_words"), F.col("_w.n_repeat_words")).alias("base_failed")))
    bad = rejected_hosts(stats, host)
    passed = docs.filter(~let(word_stats(text_or_empty()), lambda w: base_failed(w["n_words"], w["n_repeat_words"])))
    return passed.join(bad, passed[host].eqNullSafe(bad["_host"]), "left_anti")
