"""Corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of docs, in
their order and whatever they are called, so a stage works on all that its predecessor
kept. doc_id and text must be among them. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import settle, table
from lectern.llm.exact_dedup import without_copies
from lectern.llm.overlap import without_overlap
from lectern.llm.packing import pack
from lectern.llm.quality import accepted
from lectern.llm.queries import vocabulary
from lectern.llm.suffix_dedup import removed_passages


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null text is empty, a null or absent
    source a site of its own; repeated rows go or stay together."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text but for blanks, one: the longest, then that of the least
    id, null ids last. Null text is empty; of rows that repeat id and text, one stays."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their five-word shingles, the one of the
    least id, null ids last. Null text is empty; texts without words are alike. Rows that
    share an id stay or go together."""
    return without_overlap(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes that stand earlier. What a cut leaves
    of a character's bytes goes too; n_chars is that of the new text. Null text becomes
    empty; rows that repeat an id, or have none, are documents of their own."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = removed_passages(docs, carry=rest, left="text")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col("carry").getField(c)).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. Null text is empty; repeated
    rows are documents of their own; other columns are left out."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packing),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
