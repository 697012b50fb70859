"""The corpus pipeline: rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintline.llm.common import durable, read, release, temporary
from stintline.llm.decontaminate import decontaminate
from stintline.llm.line_dedup import drop_lines
from stintline.llm.ngram_join import keep_one
from stintline.llm.packing import pack_documents
from stintline.llm.quality_rules import keep_good
from stintline.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them repeat; n_chars is counted again."""
    return drop_lines(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 80 % of five-word shingles."""
    return keep_one(docs.select(*COLUMNS), size=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    return decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), remove="documents")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed token sequences, with their ids."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("packing", packed)]

#: SQL can express neither the tokens nor the certified cutoffs; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir.

    Once a stage's rows are written, the tables that it made on its way are deleted, and so are the rows of
    the stage before.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as lasting:
            docs = lasting(durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
