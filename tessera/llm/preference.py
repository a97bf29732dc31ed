"""Preference pairs: a common prompt and two masked completions.

Null roles and texts are empty. Turns with the same number are ordered by role
and text. A side without turns gives null ids and empty texts. Repeated turns
are turns. Pairs with equal sides have two empty completions and are marked
`identical`. Turns without a conversation form one pair without ids and turns.
Other columns are ignored. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The markers around a turn.
OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"


def render_turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, render_turn))


def mask_spans(turns: Column, role: str = "assistant") -> Column:
    """'start-end' character spans of the completion that are trained on: the role's texts and their end markers."""

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + len(MID)
        start = acc["at"] + head
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["s"], F.array(span))).otherwise(acc["s"]).alias("s"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("s"))
    return F.aggregate(turns, zero, step, lambda a: F.concat_ws(",", a["s"]))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (a[i]["role"] != b[i]["role"]) | (a[i]["text"] != b[i]["text"]))
    return F.coalesce(F.try_element_at(differs, F.lit(1)), n)


def turns_of(condition: Column) -> Column:
    """The turns that meet a condition, in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.array_sort(F.collect_list(F.when(condition, turn)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen_id, rejected_id, chosen, rejected), turns as arrays, -> prompt, completions and masks."""
    counted = pairs.withColumn("n_prefix", common_prefix(F.col("chosen"), F.col("rejected")).cast("long"))
    after = lambda c: F.slice(c, (F.col("n_prefix") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    cut = counted.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prefix",
        F.slice("chosen", F.lit(1), F.col("n_prefix").cast("int")).alias("p"),
        after("chosen").alias("c"),
        after("rejected").alias("r"),
    )
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prefix",
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        mask_spans(F.col("c")).alias("chosen_mask"),
        mask_spans(F.col("r")).alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs conversation 2k as chosen with 2k + 1 as rejected, in one grouping and without a join. Ids may be any long, negative too."""
    first = F.pmod("conv_id", F.lit(2)) == 0
    return conversations.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(
        F.min(F.when(first, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(~first, F.col("conv_id"))).alias("rejected_id"),
        turns_of(first).alias("chosen"),
        turns_of(~first).alias("rejected"),
    )
