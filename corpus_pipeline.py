"""Corpus pipeline: the stages in order, each on all that its predecessor kept.

``run`` writes each stage as Parquet in the shared folder and reads it again, so
that a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeflow.llm import bpe, decontam, linededup, simhash, toxicity
from scribeflow.llm.common import written
from scribeflow.llm.queries import table, word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="_toxicity", reject=0.5).drop("_toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines taken out and its length set anew."""
    kept = linededup.dedup_lines(docs, columns=("_kept", "_lines", "_dropped"))
    kept = kept.withColumns({"text": F.when(F.col("text").isNotNull(), F.col("_kept")), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("_kept").cast("long"))})
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that stays, with the digests of both directions."""
    return bpe.round_trip(docs, word_vocabulary(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaked),
    ("bpe", tokens),
]

#: Learned scores and substitution-tolerant passages have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
