"""Five stages from raw documents to a training mix, each calling an operator of quadrille.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as Parquet and
read again.  All but the last return the columns of documents.  Null and empty texts pass the filters and have size 0 in the
mix; an empty table passes as one; repeated rows are copies, of which the second stage keeps one; extra columns are carried
along up to the last stage.
"""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontam, jaccard, mixing, suffix, toxicity
from quadrille.llm._common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go.  It is fitted on the labelled rows that are not held out."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least doc_id stays."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated strings of over 50 words, or of 400 bytes, are cut out of the texts; n_chars follows.  No row goes."""
    return suffix.cut_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated strings", cut_repeats),
    ("benchmark", drop_benchmark),
    ("mix", mix),
]
#: SQL cannot express the first stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
