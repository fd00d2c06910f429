"""A corpus pipeline over the operators: quality rules, near-duplicates,
benchmark decontamination, secret scans, and the mixture of the sources.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last
return the columns of `documents`; the last returns the mixture: a row for
every use of a kept document, with its place in the training stream.

Defined cases, in every stage as in its operator: null and empty texts are read as
empty (the quality rules drop them), very long texts are read whole, repeated
rows and null ids are rows like any other, of ties one row is kept by the
operator's order, columns of any other name pass through, and an empty table
passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm import decontaminate_sw, mixing, quality_gbt, secrets_trigram, simhash_gray
from ticketlake.llm.common import written
from ticketlake.session import scratch_tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    return quality_gbt.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays (3-word shingles, 2 bits)."""
    return simhash_gray.keep_one(docs, shingle=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate_sw.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    return secrets_trigram.drop_with_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing of the sources; every kept document is used."""
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
]

#: The quality model and the aligned benchmark copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each over what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.split()[0].lower())
    return docs


def write(spark: SparkSession, sf_dir: str, out: str) -> None:
    """The corpus written to `out`; the stages' tables are removed."""
    with scratch_tables(spark):
        run(spark, sf_dir).write.mode("overwrite").parquet(out)
