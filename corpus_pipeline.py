"""A training-corpus pipeline: rules, near duplicates, secrets, mixing, packing.

All stages but the last take and return the columns of the documents, whatever
other columns there are and however they are named. Null texts have no words, so
the first stage removes them; null sources are one host and one source. Of rows
that repeat an id and a text, the near duplicates keep one; rows that share an id
but not their text are documents of their own in every stage. Ties are broken by
the least id, then by the text's digest, then by the other columns in their order.
An empty table passes all stages.
"""

from tessera.functions.store import dropped, stored
from tessera.llm import jaccard, mixing, packing, quality, secrets
from tessera.llm.common import read
from tessera.llm.queries import tokenizer_paths

# Near duplicates agree in 80 % of their shingles of five words.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.keep_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs, SHINGLE, PERCENT)


def secret_scan(spark, docs, sf_dir):
    """All documents, their secrets masked."""
    return secrets.redact_documents(docs)


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.mixed_copies(docs)


def packed(spark, docs, sf_dir):
    """Token pieces of all documents with their places in the sequences."""
    return packing.pack_documents(docs, *tokenizer_paths())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: The packing and the components have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to the documents one after another, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
