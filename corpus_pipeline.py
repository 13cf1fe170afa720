"""From documents to packed windows: language identification, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents, in their order, whatever other columns docs has. An empty table
gives an empty one in every stage, and rows with nulls are handled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import langid, line_dedup, near_dedup, packing
from winnow.llm.common import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows have; those that language identification rejects go.

    A null, empty or letterless text is rejected; repeated rows stay as often as they come; without labels nothing stays.
    """
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those that consist of nothing else go.

    A document with a null or empty text stays as it is; of rows repeated with id and text one stays.
    """
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id, null ids last.

    Null texts are equal to each other, so one of them stays; texts without a word are grouped only if they are the same.
    """
    return near_dedup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows.

    A document without tokens has one row without a window; repeated rows are each placed.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("packing", packed)]

#: Training, connected groups and the fit of packs are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
