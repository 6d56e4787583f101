"""The document pipeline: language ID, line dedup, near-duplicates, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage's
result is written as Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents.

1. language: documents without a text or a letter go, and those far less likely in every learned language than the
   labelled documents are.
2. lines: lines of 40 characters or more found in five documents or more go, but for the last document that
   has them; n_chars follows the text. Documents that are left without a word go.
3. near_dups: one document, the smallest doc_id, stays of each group of similar documents (five-word
   shingles, Jaccard similarity 0.8 or more).
4. mix: whole documents are drawn to the target weights of their sources, at most twice each.
5. pack: every document's words are placed in bins of fixed length; one row per piece.

Defined results: an empty table passes through as an empty table; nulls in columns other than the text are
kept; a repeated row is a document like any other until stage 3, which lets one of them through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm.common import n_words, read_documents
from riskframe.llm.language import accepted
from riskframe.llm.line_dedup import dedup_lines
from riskframe.llm.mixing import mixed_documents
from riskframe.llm.near_dups import kept_documents
from riskframe.llm.packing import pack
from riskframe.session import stage_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    t = dedup_lines(docs)
    named = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    t = t.filter((n_words(F.col("kept")) > 0) | (F.col("n_dropped") == 0))
    return t.select(*[named[c].alias(c) if c in named else F.col("row")[c].alias(c) for c in docs.columns])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_dups", near_dups), ("mix", mix), ("pack", packed)]

#: Model fits and sketches have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
