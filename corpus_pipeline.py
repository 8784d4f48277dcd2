"""Documents to packed sequences: toxicity, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next stage's documents. Null texts are empty texts, null and
shared doc_ids are allowed, an empty table gives no rows, and only the columns of documents are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlspark.llm import mixing, near_dup, packing, toxicity
from crawlspark.llm.scratch import Scratch
from crawlspark.plans.inputs import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two language models find toxic go; the models learn from the labelled rows of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "_score").where(F.col("_score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id."""
    return near_dup.kept_documents(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source's share of the words comes to its target: documents are drawn, repeated or left out."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of 2048 ids, in its order."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained models, hashed draws and tokenisers are not SQL; tests/llm/test_odd_ids.py holds the stages against plain versions
# (toxicity against the labels).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a table folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
