"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

Every stage works on all that the one before it kept.  The first three decide
what stays; mixing orders the rows by the schedule of their sources, and its
files and the rows in them keep that order; packing numbers its sequences along
it and returns their pieces.
"""

from __future__ import annotations

import functools
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, neardup, packing, suffixes, toxicity
from strandline.llm.queries import tokenizer_path
from strandline.llm.ship import ship
from strandline.llm.store import fresh_path, recorded, remove


#: A repeated passage: more than 50 words in one run of repeated strings of this many bytes.
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_BAND, PASSAGE_WORDS = 200, 50, 76, 51

#: tables behind a stage's result, for each thread and input
_made: dict[tuple[int, str], list[str]] = {}


def stage(fn):
    """A stage.  Its input has been written, so the tables behind the stage before are removed first."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        run = threading.get_ident(), sf_dir
        for path in _made.pop(run, []):
            remove(spark, path)
        own: list[str] = []
        with recorded(own):
            out = fn(spark, docs, sf_dir)
        _made[run] = own
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.distinct_documents(docs)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of more than 50 words that also stand elsewhere."""
    return suffixes.cut_texts(docs, PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_BAND, PASSAGE_WORDS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the sources' schedule."""
    return mixing.mixed(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, along the order of the files and the rows in them."""
    order = ["_metadata.file_name", "_metadata.row_index"]
    try:
        docs.select(*order)
    except AnalysisException:  # not read from files
        order = []
    return packing.pack(docs, tokenizer_path(), keep_words=False, order=order)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = fresh_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
