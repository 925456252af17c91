"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last
return the columns of documents; the last returns a row for each piece of a document in a training sequence.

Defined cases, for every stage: null, empty and wordless texts fail the quality rules, so later stages see none of them, though each takes
them; a null doc_id, lang or source is a value like any other; repeated rows stay or go together; very long texts are handled whole; ties are
decided as the operators state; an empty table gives an empty one; extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from terraloom.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the labels of the corpus calibrate the cutoffs."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.distinct_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; the forest is trained on this stage's input."""
    model, words = secret_scan.train(docs, "source")
    return secret_scan.redact(docs, model, words, "source")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources, once for each epoch."""
    return mixing.mixed_documents(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", deduplicate),
    ("secret scan", secrets),
    ("source mixing", mix),
    ("packing", pack),
]

#: The stages use hashed signatures, a fitted forest and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, as in production, and its input then deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            room = Scratch(spark)
            docs = room.stage(docs, name.replace(" ", "-"))
            if last is not None:
                last.close()
            last = room
    return docs
