"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which `run` writes to the shared folder and
reads again as the next stage's documents. All but the last return the columns of `documents`;
`n_chars` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, line_dedup, near_dups, packing, quality
from logloom.llm.queries import END_ID, VOCABULARY, table
from logloom.session import settle, tune


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    tune(spark)
    return quality.filter_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has."""
    tune(spark)
    kept = line_dedup.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    tune(spark)
    return near_dups.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question."""
    tune(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), verbatim=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    tune(spark)
    pieces = packing.with_crc(packing.pack(docs, VOCABULARY, END_ID))
    return packing.numbered(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Near duplicates and tokens are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
