"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of `documents`. The classifier learns from those of its input's documents that
have a label and aren't held out (see tidemark.llm.quality.report).

Nulls, ties and repeats: each stage judges rows, not ids. A null text counts as empty and is scored as such; a null or repeated
doc_id takes no other text with it; of rows with one id and one text a single one stays; ties go to the least doc_id. An empty table goes through all stages
as one. Columns besides doc_id and text are carried along and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, exact_dedup, near_dup, packing, quality, tokens
from tidemark.llm.common import discard, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_bad(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_copies(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_path(), end_id=2, size=1024)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dup", drop_near_copies), ("decontam", drop_contaminated), ("packing", pack)]

# A fitted model and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; what each returns is written before the next reads it, and deleted when the next is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
