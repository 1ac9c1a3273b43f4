"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, documents are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattika.llm import lshforest, mixing, packing, toxicity
from lattika.llm.common import Scratch, read_table
from lattika.llm.queries import tokenizer

#: Documents are near copies when they share this much of their five-word shingles; op3's own contract is 85.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the weakly supervised classifier calls toxic."""
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with only the smallest doc_id of each near-duplicate component, of pairs from NEAR_PERCENT on."""
    return lshforest.deduplicated(docs, NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs in the order of the Pfair mixture: files and the rows in them follow it; packing places them anew, as files aren't read in their order."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids.

    Spark reads the files back by size, so the mixture's order is made again: a row's position depends on the rows alone.
    """
    return packing.pack(mixing.mixed(docs), tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No stage but the last two could be SQL: a trained classifier and token ids aren't. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
