"""A corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of documents. ``run`` applies the stages in order, each over the written rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import decontamination, ngram_join, packing, sanitising, toxicity
from tamis.llm.common import read, rows_in
from tamis.staging import stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (8): documents of a score at or above the threshold go."""
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.kept(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (3): of each group the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (6): contaminated documents go."""
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    return rows_in(docs, found.where("contaminated"), "doc_id", "text", "left_anti")


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (7): personal data and revealing terms are taken out of the texts; n_chars follows."""
    return sanitising.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (2): the pieces of all documents, placed into sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", take_out_personal_data),
    ("best_fit_packing", pack),
]

# Learned scores, tokenizers and packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
