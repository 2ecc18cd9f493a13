"""From raw documents to packed sequences: five stages, each the work of one operator.

Every stage reads what the one before has kept, as Parquet, and its decisions take effect: toxic documents go, repeated
blocks leave the later texts, one document of each near-duplicate group stays, documents stand as often as the mix takes
them, and the last stage packs what is left. All but the last return the columns of documents.

Rows with null ids, null, empty, blank or very long texts, repeated rows, repeated ids, further columns of any name and
empty tables pass through every stage as its operator's docstring says: null and empty texts score as texts without
windows, have no lines, are near copies of each other (one of them stays), have size 0, so the mix takes none of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pentad.llm.common import table, tables_dir
from pentad.llm.line_dedup import deduplicate
from pentad.llm.mixing import mixed
from pentad.llm.packing import pack
from pentad.llm.simhash import keep_one
from pentad.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op10 marks as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document holds leave the later ones; n_chars follows."""
    kept = deduplicate(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents stand as often as its target asks for."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages fit a classifier and pack by retrieval, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{tables_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
