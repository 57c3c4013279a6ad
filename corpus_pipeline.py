"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's documents.  All stages but the last return the columns of ``documents``.

Every stage bears nulls in any column, empty and very long texts, ties, repeated rows and an empty table, which gives no
rows; what each does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from voxmill.llm.common import Scratch
from voxmill.llm.queries import table, word_tokenizer

#: No source is read more often than this; the largest is read once, so no document is lost by mixing.
MAX_REPETITION = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject.  A null or empty text has too few words and goes; a null id has no label but is judged
    like any other; repeated rows go or stay together; a very long text is measured whole."""
    return quality_rules.filter_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the least id, a null id last; null and empty texts
    are equal; of rows that agree in id and text one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the least id, a null id last; texts without words are one class."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source is read, in the order of the mixture.  A null source is a source; texts without
    words are read once or with their block; equal ids are read together."""
    mixed = mixing.mix_sources(docs, max_repetition=MAX_REPETITION)
    # Slot and order are no columns of documents: the order of the rows in the files carries them to packing.
    ordered = mixed.repartitionByRange("mix_slot", "mix_order").sortWithinPartitions("mix_slot", "mix_order")
    return ordered.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 ids.  A null or empty text is the end id alone; a long one is cut into full windows; each row is packed
    by itself, so a document that is read twice is packed twice."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: The forest, the sketches and best-fit packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
