"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing."""

from millrace.llm.common import read, staged
from millrace.llm.exact_dedup import drop_exact_duplicates
from millrace.llm.mixing import mixed_rows
from millrace.llm.packing import pack_documents
from millrace.llm.simhash import drop_similar
from millrace.llm.tokenizing import public_path
from millrace.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the model rejects go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of texts linked by 0.8 of their five-word shingles in common stays."""
    return drop_similar(docs)


def mixing(spark, docs, sf_dir):
    """Documents are copied and sampled to the weights of their sources."""
    return mixed_rows(docs)


def packing(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Neither the network nor tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # Written and read again, so that no stage is computed twice.
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
