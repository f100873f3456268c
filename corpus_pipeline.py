"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
``docs``; the last one adds ``copies``, how often a document goes into the mix. An empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.decontaminate import drop_leaking
from tracewell.llm.linededup import drop_repeated_lines
from tracewell.llm.mixing import take_mix
from tracewell.llm.quality import keep_good
from tracewell.llm.simhash import keep_one_of_each
from tracewell.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a risk-controlled rule go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words go, and documents that are nothing but such copies."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), "n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of copies."""
    return take_mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("source mix", mix_sources),
]

# Exact binomial bounds and fingerprints have no form in SQL; tests compare with plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
